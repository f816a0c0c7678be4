"""Corpus operators against brute force, round trips and the cases that each must survive."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import byte_bpe, decontaminate, language_id, line_templates, quality_rules, quality_zstd, simhash, substring_dedup, toxicity, url_filter
from tidewater.llm.common import Store, fold, sampled

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, fp string, words string, score string, host string, w string"
rnd = random.Random(3)
VOCAB = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, prose(60, 1)), (4, prose(60, 1)), (4, prose(60, 1)), (5, prose(30_000, 2)), (6, "a"), (7, "🙂 é x")]
MAKERS = {
    "op1": lambda d: substring_dedup.find(d),
    "op3": lambda d: quality_zstd.score(d, quality_zstd.train(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))),
    "op4": lambda d: language_id.identify(d, language_id.train(d, F.lit(True))),
    "op5": lambda d: decontaminate.find(d, d.sparkSession.createDataFrame([(1, prose(60, 1)), (2, None), (None, "x"), (3, "")], "item_id long, text string")),
    "op6": lambda d: quality_rules.judge(d),
    "op7": lambda d: byte_bpe.tokenize(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    "op8": lambda d: line_templates.dedupe(d),
    "op9": lambda d: toxicity.score(d, toxicity.train(d, d.sparkSession.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int"), F.lit(True))),
    "op10": lambda d: simhash.group(d),
}


@pytest.mark.parametrize("name", MAKERS)
def test_odd_rows_and_empty_tables(spark, name):
    got = MAKERS[name](frame(spark, ODD)).collect()
    if name not in ("op1", "op5"):
        assert len(got) == len(ODD)
    assert MAKERS[name](frame(spark, [])).count() == 0


def test_url_rules_by_brute_force(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "org/a"), ("block", "b.org/")]
    hosts = ["com", "example.com", "WWW.example.com", "xexample.com", "a.b.org", "b.org:80", "net", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/x?q=/en/", "/es/1#t", "/abc/d", "?a=/en/")] + [None, "", "no scheme", "://x"]
    pages = spark.createDataFrame([(i % 40, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")

    def expect(u):
        m = regex.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(r), len(r.split("/")[0]), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")

    for limit in (100, 1):
        got = url_filter.decide(pages, url_filter.rule_table(spark, rules), broadcast_rules=limit).collect()
        assert Counter(tuple(r) for r in got) == Counter((i % 40, *expect(u)) for i, u in enumerate(urls))


def test_bpe_is_tiktoken():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    codec = byte_bpe.Codec(byte_bpe.model_bytes(ranks), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(chr(r.choice([32, 10, 0x85, 0xA0, 0x3000, 65, 97, 39, 0xE9, 0x4E2D, 0x1F600, 0x661, r.randrange(32, 0xD7FF)])) for _ in range(r.randrange(50))) for _ in range(2000)]
    for t in [*texts, "", "a" * 3000, " " * 500 + "x", "don't I'll"]:
        ids = codec.encode(t)
        assert ids.tolist() == own.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_pieces_are_longest_matches():
    r = random.Random(9)
    texts = {"x": language_id.plain(prose(300, 5)), "y": language_id.plain(prose(300, 6)[::-1] + " 漢字かな交じり文 мир")}
    model = language_id.Model(texts)
    tests = [prose(80, 7), prose(20, 5), "!!", "", "ö x", "漢字 qq 文字", prose(1, 1), prose(3000, 8), "z" * 5000, prose(300, 5) * 4]
    tests += [" ".join(r.choice([prose(40, 5), prose(40, 6)[::-1], "ßß", "字"]) for _ in range(r.randrange(1, 60))) for _ in range(30)]
    plain = [language_id.plain(t) for t in tests]
    counts, sizes = model.pieces(plain)
    for j, t in enumerate(plain):
        assert sizes[j] == len(t)
        for k, lang in enumerate(model.langs):
            n = at = 0
            while at < len(t):
                to = at + 1
                if t[at:to] in texts[lang]:
                    while to < len(t) and t[at : to + 1] in texts[lang]:
                        to += 1
                at, n = to, n + 1
            assert counts[k, j] == n


def test_training_pieces_come_from_whole_texts(spark):
    rows = frame(spark, [(i, " ".join(f"w{j}" for j in range(5000))) for i in range(40)] + [(i, prose(9, i)) for i in range(40, 80)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(3, 1), (None, 1)], "doc_id long, quality int")
    got = sampled(rows, labels, "quality", 1000, 100, 3)
    assert [r.doc_id for r in got] == list(range(80)) and all(len(r.parts) == 3 and all(len(p) == 100 for p in r.parts) for r in got[:40])
    text = rows.where("doc_id = 1").first().text
    places = [text.index(p) for r in got[:40] for p in r.parts]
    assert max(places) > 0.9 * len(text) and all(x in text for x in got[0].parts) and got[50].parts == [prose(9, 50)]
    assert 4 <= len(sampled(rows, labels, "quality", 10, 100, 3)) <= 40 and sampled(rows, labels.limit(0), "quality", 10, 100, 3) == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    langs = language_id.identify(docs, language_id.train(docs, fold("doc_id", 4) != 2)).where(fold("doc_id", 4) == 2).select((F.col("lang") == F.col("lang_pred")).alias("ok")).toPandas()
    assert langs.ok.mean() > 0.97
    got = quality_zstd.score(docs, quality_zstd.train(docs, labels, fold("doc_id", 5) != 0)).where(fold("doc_id", 5) == 0).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.9


def test_risk_never_rewards_negative_parts():
    positive = np.array([True, False])
    risk, gradient = toxicity.risk_gradient(np.array([5.0, -9.0]), positive, 0.9)
    assert risk >= 0 and gradient[0] > 0  # the clean part is below zero: its gradient is turned round


def test_repeated_words_by_brute_force(spark):
    docs = [(i, prose(200, i) + " " + prose(20, i + 1 - i % 3) + " " + prose(200, i)[: i * 9]) for i in range(20)] + [(99, "a a a a"), (98, "a b"), (97, None)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, docs)).collect()}
    for i, t in docs:
        w = (t or "").split()
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j + k for j, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[g] > 1 for k in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(cover))


def test_recurring_lines(spark):
    rows = [(i, f"{prose(12, 100 + i)}\nPage {i} of the long report by the same old author {i}\n{prose(12, 200 + i)}") for i in range(8)]
    rows += [(50 + i, prose(12, 1) + "\n" + prose(14, 2)) for i in range(5)]  # copies bring their surroundings along
    got = {r.doc_id: r for r in line_templates.dedupe(frame(spark, rows)).collect()}
    assert all(got[i].n_dropped == 1 and "Page" not in got[i].text for i in range(8))
    assert all(got[50 + i].n_dropped == 0 for i in range(5))


def test_blocks_and_lines_of_copies_recur(spark):
    notice = [prose(9, 801), prose(9, 802), prose(9, 803)]
    rows = [(i, "\n".join([prose(12, 100 + i), *notice, prose(12, 200 + i), prose(12, 300 + i)])) for i in range(5)]
    rows += [(20 + i, "\n".join([prose(12, 400 + i), prose(12, 500 + i), *notice])) for i in range(3)]
    line = prose(9, 804)
    rows += [(100 + i, f"{prose(12, 1)}\n{line}\n{prose(12, 2)}") for i in range(40)]  # copies, and few unlike documents
    rows += [(200 + i, f"{prose(12, 600 + i)}\n{line}\n{prose(12, 700 + i)}") for i in range(4)]
    copied = [prose(12, 900 + k) for k in range(12)]
    rows += [(300 + i, "\n".join(prose(12, 1000 + i) if k == i else x for k, x in enumerate(copied))) for i in range(12)]  # near copies
    got = {r.doc_id: r for r in line_templates.dedupe(frame(spark, rows)).collect()}
    assert all(got[i].n_dropped == 3 for i in [*range(5), *range(20, 23)])
    assert all(got[i].n_dropped == 1 and line not in got[i].text for i in [*range(100, 140), *range(200, 204)])
    assert all(got[300 + i].n_dropped == 0 for i in range(12))


def test_short_lines_recur_by_their_full_text(spark):
    rows = [(i, f"{prose(12, 100 + i)}\nRead  more\n\n{prose(12, 200 + i)}\nPage {i}\n{prose(12, 300 + i)}\nEnd.") for i in range(5)]
    got = {r.doc_id: r for r in line_templates.dedupe(frame(spark, rows)).collect()}
    for i, t in rows:
        assert got[i].n_dropped == 2 and got[i].text.split("\n") == [x for x in t.split("\n") if x not in ("Read  more", "End.")]


def test_variable_tokens_anywhere(spark):
    names = [prose(1, 5000 + i) + prose(1, 6000 + i) for i in range(40)]
    forms = ["Posted by {} in category news today", "{} wrote this comment on the page", "Shared on {} from the old station of {}"]
    rows = [(i, "\n".join([prose(12, 100 + i), forms[i % 3].format(names[i], names[39 - i]), prose(15, 200 + i)])) for i in range(24)]
    got = {r.doc_id: r for r in line_templates.dedupe(frame(spark, rows)).collect()}
    assert all(got[i].n_dropped == 1 for i in range(24) if i % 3 < 2)  # all differing tokens are in one third
    assert all(prose(12, 100 + i) in got[i].text and prose(15, 200 + i) in got[i].text for i in range(24))


def test_line_dedup_by_brute_force(spark):
    r = random.Random(21)
    lines = [prose(r.randint(1, 12), 7000 + i) for i in range(60)]

    def varied(line):
        w = line.split()
        if r.random() < 0.5 and len(w) > 2:
            w[r.randrange(len(w))] = r.choice([*VOCAB, "x1", "77"])
        return "  ".join(w)

    texts = ["\n".join(r.choice([prose(8, r.randrange(10**6)), varied(r.choice(lines)), "", r.choice(lines)]) for _ in range(r.randint(1, 9))) for _ in range(120)]
    texts += [texts[3]] * 5 + ["\n".join([*texts[5].split("\n"), prose(5, k)]) for k in range(4)]
    key = {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
    key = {t: k - (1 << 64) if k >> 63 else k for t, k in key.items()}
    parsed, size = {}, {}
    for t, doc in key.items():
        rows = []
        for at, line in enumerate(t.split("\n")):
            raw = line.split()
            if not raw:
                continue
            g, n = ["<*>" if regex.search("[0-9]", w) else w for w in raw], len(raw)
            cut = [0, n // 3, 2 * n // 3, n]
            own = [("short", *raw)] if n < 3 else [(n, None, *g)]
            own += [(n, k, *g[: cut[k]], "", *g[cut[k + 1] :]) for k in range(3) if n - (cut[k + 1] - cut[k]) >= 4]
            rows.append((at, len(regex.sub(r"\s+", " ", line)), own))
        parsed[doc] = rows
        size[doc] = sum(len(regex.sub(r"\s+", " ", line)) for line in t.split("\n"))
    holders = {}
    for doc, rows in parsed.items():
        for _, _, own in rows:
            for x in own:
                holders.setdefault(x, set()).add(doc)
    families = {}
    for doc, rows in parsed.items():
        firsts = [min((min(holders[x]) for x in own if len(holders[x]) > 1), default=None) for _, _, own in rows]
        words = Counter({doc: 0})
        for (_, n, _), f in zip(rows, firsts, strict=True):
            words[doc if f is None else f] += n
        total = size[doc]
        words[doc] += total - sum(words.values())
        for i, f in enumerate(firsts):
            if f is None:
                continue
            lo = hi = i
            while lo and firsts[lo - 1] == f:
                lo -= 1
            while hi + 1 < len(rows) and firsts[hi + 1] == f:
                hi += 1
            if words[f] >= 0.8 * total:
                family = f
            else:
                rest = Counter(words) | Counter({doc: 0})
                best = [(words[x] - (sum(n for _, n, _ in rows[lo : hi + 1]) if x == f else 0), x == doc, x) for x in {*rest, doc, f}]
                family = max(best)[2]
            for x in rows[i][2]:
                if len(holders[x]) > 1:
                    families.setdefault(x, {}).setdefault(doc, set()).add(family)
    drop = {x for x, by in families.items() if len({min(f) for f in by.values()}) >= 3}
    got = line_templates.dedupe(frame(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts) and any(x.n_dropped for x in got)
    for row in got:
        t = texts[row.doc_id]
        gone = {at for at, _, own in parsed[key[t]] if drop & set(own)}
        assert row.n_dropped == len(gone) and row.text == "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone)


def test_line_dedup_with_helper_names_and_null_ids(spark):
    names = ["kept", "bad", "leaf", "first", "text_key", "n", "k", "at", "l0", "family", "n_lines", "BAD_"]
    rows = [(None if i % 2 else i, f"{prose(12, 100 + i)}\nsame line of all these documents\n{prose(12, 200 + i)}", *[f"{c}{i}" for c in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = line_templates.dedupe(docs).collect()
    assert len(got) == 6 and all(r.n_dropped == 1 and r.n_lines == 3 and "same line" not in r.text for r in got)
    assert {tuple(r[c] for c in names if c != "n_lines") for r in got} == {tuple(f"{c}{i}" for c in names if c != "n_lines") for i in range(6)}


def test_fingerprints_and_components_by_brute_force(spark):
    base = [prose(120, s) for s in range(6)]
    r = random.Random(5)
    rows = []
    for i in range(150):
        w = base[i % 6].split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE")]
    fps = {}
    for i, t in rows:
        w = (t or "").lower().split()
        s = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    label = {i: i for i in fps}
    for _ in range(8):
        for a in fps:
            label[a] = min(label[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3)
    for members in (2048, 30, 4):  # the last refines cells and deals groups over several tasks
        got = {x.doc_id: x for x in simhash.group(frame(spark, rows), members=members).collect()}
        assert {i: x.fp & (1 << 64) - 1 for i, x in got.items()} == fps
        assert {i: x.component_id for i, x in got.items()} == label


def test_gray_index_finds_all_links():
    r = np.random.default_rng(2)
    centre = r.integers(0, 1 << 62, 5, dtype="int64").view("uint64")
    fp = np.unique(np.concatenate([c ^ (np.uint64(1) << r.integers(0, 64, (150, 3)).astype("uint64")).sum(1).astype("uint64") for c in centre]))
    rank = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    fp = fp[np.argsort(rank)]
    differ = np.bitwise_count(fp[:, None] ^ fp[None, :])
    for upper in (1, 3):
        a, b = simhash.gray_links(fp, np.zeros(len(fp), "int64"), np.zeros(len(fp), "int64"), np.zeros(len(fp), bool), 3, upper)
        assert (differ[a, b] <= 3).all()
        x, y = np.nonzero((differ <= 3) & (np.bitwise_count((fp[:, None] ^ fp[None, :]) & simhash.UPPER) <= upper))
        own, all_ = simhash.roots(len(fp), a, b), simhash.roots(len(fp), x, y)
        assert (own[x] == own[y]).all() and (upper == 1 or (own == all_).all())


def test_links_of_dense_and_sparse_cells(spark):
    r = np.random.default_rng(5)
    fp = r.integers(0, 1 << 63, 600, dtype="int64").view("uint64")
    centre = np.uint64(0x123456789ABCDEF0)
    near = centre ^ (np.uint64(1) << r.integers(0, 64, (400, 4)).astype("uint64")).sum(1).astype("uint64")
    low = centre ^ r.integers(0, 1 << 10, 300, dtype="int64").view("uint64")  # all of one upper half
    far = fp[:200] ^ (np.uint64(1) << r.integers(0, 64, 200).astype("uint64"))
    fp = np.unique(np.concatenate([fp, near, low, far]))
    nodes = spark.createDataFrame(list(zip(fp.view("int64").tolist(), range(len(fp)), strict=True)), "fp long, node long")
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    expect = simhash.roots(len(fp), x, y)
    for members in (4096, 100, 16):
        found = np.array([(e.a, e.b) for e in simhash.links(nodes, Store(spark), 3, members).collect()])
        assert (np.bitwise_count(fp[found[:, 0]] ^ fp[found[:, 1]]) >= 1).all()
        assert (simhash.roots(len(fp), found[:, 0], found[:, 1]) == expect).all()


def test_decontamination_by_brute_force(spark):
    items = [(k, prose(n, 300 + k)) for k, n in enumerate((15, 24, 40, 58))]
    r = random.Random(4)
    rows = []
    for i in range(60):
        k = i % 4
        w = items[k][1].split()
        for _ in range(i % 3):
            w[r.randrange(len(w))] = "changed"
        rows.append((i, prose(30, i) + " -- " + ",  ".join(x.upper() for x in w) + "! " + prose(30, i + 99)))
    rows.append((99, prose(300, 77)))
    expect = set()
    for i, t in rows:
        w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
        for k, x in items:
            own = x.split()
            b = Counter(zip(*[own[j:] for j in range(5)], strict=False))
            for s in range(len(w) - len(own) + 1):
                a = Counter(zip(*[w[s + j : s + len(own)] for j in range(5)], strict=False))
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    expect.add((i, k))
    for table in (decontaminate.TABLE, 0):
        got = {(x.doc_id, x.item_id) for x in decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), table=table).collect()}
        assert got == expect and len(expect) >= 20


def test_short_and_very_long_items(spark):
    long = prose(9000, 320)
    items = [(1, long), (2, "two words"), (3, "Alone"), (4, "a b c d"), (5, ""), (6, None)]
    tail = " ".join(long.split()[-8:])
    rows = [(1, prose(20, 321) + " " + tail), (2, prose(20, 322) + " " + long + " " + prose(20, 323)), (3, "here are two, words -- alone"), (4, "a b c d"), (5, "a b c"), (6, "two"), (7, prose(30, 1))]
    for table in (decontaminate.TABLE, 0):  # the second joins with the shingles
        found = decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), similarity=1.0, table=table).collect()
        assert {(x.doc_id, x.item_id) for x in found} == {(2, 1), (3, 2), (3, 3), (4, 4)} and all(x.similarity == 1 for x in found)


def test_simhash_of_many_words(spark):
    for n in (16_383, 16_384, 20_001):
        w = prose(n, 330).split()
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        expect = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)
        got = spark.createDataFrame([(" ".join(w),)], "t string").selectExpr("split(t, ' ') AS w").select(F.expr(decontaminate.simhash("w")).alias("fp")).first().fp
        assert got & (1 << 64) - 1 == expect


def test_items_that_overlap_in_one_long_row(spark):
    w = prose(120, 310).split()
    items = [(k, " ".join(w[k * 6 : k * 6 + 24])) for k in range(17)]
    rows = [(1, " ".join([prose(30, 311), *w, prose(30, 312)])), (2, " ".join(w)), (3, " ".join([*w[10:50], "changed", *w[51:90]]))]
    found = decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id): x for x in found}
    assert all(got[1, k].start == 30 + 6 * k and got[2, k].start == 6 * k and got[1, k].similarity == 1 for k in range(17))
    assert {k for d, k in got if d == 3} >= {2, 3, 4, 9, 10, 11}


def test_shared_passages(spark):
    passage = prose(80, 500).split()
    fuzzy = passage[:30] + ["other", "words"] + passage[31:55] + passage[57:]
    rows = [(i, prose(200, i)) for i in range(10)] + [(20 + i, prose(50, 50 + i) + " " + " ".join(passage if i % 2 else fuzzy) + " " + prose(50, 80 + i)) for i in range(6)]
    got = substring_dedup.find(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} | {p for r in got for p in r.partners} == {20 + i for i in range(6)}
    assert all(50 <= r.n_words <= 90 for r in got)


def changed(words, ats):
    return [f"new{j}" if j in ats else w for j, w in enumerate(words)]


def test_chains_are_cut_at_unlike_gaps():
    two = [changed(prose(100, s).split(), {45, 90}) for s in (1, 2)]
    for gap, expect in ((100, [(0, 100), (200, 300)]), (10, [(0, 210)])):
        a, b = two[0] + prose(gap, 3).split() + two[1], prose(100, 1).split() + [f"x{i}" for i in range(gap)] + prose(100, 2).split()
        seg = [(0, 0, 45), (46, 46, 44), (100 + gap, 100 + gap, 45), (146 + gap, 146 + gap, 44)]
        assert [(x, y) for x, y, _ in substring_dedup.align(a, b, seg, 0.8)] == expect


def test_ends_grow_over_changes():
    own = prose(60, 4).split()
    for ats in ({8, 52}, {5, 15, 25, 35, 45, 55}):
        a, b = prose(30, 5).split() + changed(own, ats) + prose(30, 6).split(), prose(40, 7).split() + own + prose(40, 8).split()
        (x, y, like), = substring_dedup.align(a, b, [(57, 67, 5)], 0.8)
        assert x <= 32 and y >= 88 and y - x <= 66 and like >= 0.8
    a = prose(30, 5).split() + own[:10] + ["put", "in"] + own[10:50] + own[51:] + prose(30, 6).split()
    (x, y, _), = substring_dedup.align(a, b, [(57, 65, 5)], 0.8)
    assert x <= 32 and y >= 88


def test_recall_of_changed_passages(spark):
    r = random.Random(11)
    rows, expect = [], {}
    for i in range(60):
        own = [f"p{i}-{j}" for j in range(60)]
        ats = set(r.sample(range(60), 5)) if i % 2 else set(range(5, 60, 10))
        rows += [(i, f"{prose(40, 3000 + i)} {' '.join(own)} {prose(40, 3100 + i)}"), (100 + i, f"{prose(30, 3200 + i)} {' '.join(changed(own, ats))} {prose(30, 3300 + i)}")]
        expect[100 + i] = i
    got = {x.doc_id: x.partners for x in substring_dedup.find(frame(spark, rows)).collect()}
    assert all(expect[k] in v for k, v in got.items() if k in expect) and len(got) >= 51  # nine in ten; 3 in 4 with seeds of 16


def test_a_passage_whose_seeds_are_first_in_another_document(spark):
    own = prose(60, 77).split()
    rows = [(1, " ".join([prose(40, 3401), *own[:30], prose(40, 3402)])), (5, " ".join([prose(40, 3403), *own, prose(40, 3404)])), (9, " ".join([prose(40, 3405), *changed(own, {31}), prose(40, 3406)]))]
    got = {x.doc_id: x for x in substring_dedup.find(frame(spark, rows)).collect()}
    assert set(got) == {9} and 5 in got[9].partners and got[9].start <= 42 and got[9].start + got[9].n_words >= 98


def test_seeds_by_brute_force():
    r = random.Random(13)
    texts = [prose(n, 9000 + n).encode().split() for n in (0, 3, 4, 5, 8, 11, 12, 13, 200)] + [[b"ha"] * 40, [], [b"a", b"b"] * 30]
    texts += [r.choices([b"x", b"y", b"z"], k=r.randrange(60)) for _ in range(50)]
    h, at, owner = substring_dedup.seeds_of([b" \t".join(t) + b"\n" for t in texts])
    for i, words in enumerate(texts):
        own = substring_dedup.runs_of(substring_dedup.word_hashes([b" ".join(words)])[0], 5) if len(words) >= 5 else np.zeros(0, "uint64")
        wins = [own[j : j + 8] for j in range(max(1, len(own) - 7))] if len(own) else []
        expect = {j + d for j, w in enumerate(wins) for d in range(len(w)) if w[d] == w.min()}
        assert set(at[owner == i].tolist()) == expect and (h[owner == i].view("uint64") == own[at[owner == i]]).all()


def test_an_id_of_several_texts_and_copies(spark):
    long, other = prose(80, 41), prose(90, 42)
    rows = [(1, long), (1, other), (1, other), (2, long + " " + prose(30, 43)), (3, other + " " + prose(30, 44)), (5, prose(70, 45)), (5, prose(70, 45)), (6, prose(70, 45)), (9, prose(70, 45)), (8, prose(20, 46)), (10, prose(20, 46))]
    got = {r.doc_id: r for r in substring_dedup.find(frame(spark, rows)).collect()}
    held = 2 if xxhash.xxh64_intdigest(long.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(long.encode(), 42) >> 63) < xxhash.xxh64_intdigest(other.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(other.encode(), 42) >> 63) else 3
    assert set(got) == {held, 6, 9} and got[held].partners == [1]
    assert all((got[i].start, got[i].n_words, got[i].partners) == (0, 70, [5]) for i in (6, 9))


def test_recall_behind_earlier_pieces(spark):
    """Changed passages of which each piece is in another document first, against chaining all documents with all."""
    rows, expect = [], {}
    for i in range(20):
        own = [f"q{i}-{j}" for j in range(100)]
        base = 100 * i
        rows += [(base + c, f"{prose(20, 8000 + base + c)} {' '.join(own[c * 24 : c * 24 + 24])} {prose(20, 8050 + base + c)}") for c in range(4)]
        rows.append((base + 10, f"{prose(40, 8060 + base)} {' '.join(own)} {prose(40, 8061 + base)}"))
        rows += [(base + 20 + c, f"{prose(20, 8070 + base + c)} {' '.join(own[c * 24 + 5 : c * 24 + 29])} {prose(20, 8080 + base + c)}") for c in range(3)]
        ats = {13 + i % 5, 47 + i % 7, 80 + i % 3}
        rows.append((base + 30, f"{prose(40, 8062 + base)} {' '.join(changed(own, ats))} {prose(40, 8063 + base)}"))
        expect[base + 30] = base + 10
    got = {x.doc_id: x for x in substring_dedup.find(frame(spark, rows)).collect()}
    hits = sum(k in got and v in got[k].partners and got[k].n_words >= 80 for k, v in expect.items())
    print("recall behind earlier pieces", hits / len(expect))
    assert hits >= 0.9 * len(expect)


def test_changed_passages_whose_pieces_all_stand_earlier(spark):
    """Every place of the seeds is looked at: others hold all pieces, also pieces over the changes, before and after the partner."""
    rows, expect = [], {}
    for i in range(10):
        own, base = [f"r{i}-{j}" for j in range(100)], 1000 * i
        cuts = [(c, c + 24) for c in range(0, 100, 6)]
        rows += [(base + 500 * late + c, f"{prose(20, 20_000 + base + 500 * late + c)} {' '.join(own[c:d])} {prose(20, 21_000 + base + 500 * late + c)}") for c, d in cuts for late in (0, 1)]
        rows.append((base + 200, f"{prose(40, 30_000 + i)} {' '.join(own)} {prose(40, 31_000 + i)}"))
        rows.append((base + 900, f"{prose(40, 32_000 + i)} {' '.join(changed(own, {14 + i % 5, 47 + i % 7, 80 + i % 3}))} {prose(40, 33_000 + i)}"))
        expect[base + 900] = base + 200
    got = {x.doc_id: x for x in substring_dedup.find(frame(spark, rows)).collect()}
    assert set(expect) <= set(got)
    assert all(v in got[k].partners and got[k].n_words >= 90 for k, v in expect.items())


def test_every_exact_repeat_is_in_a_region(spark):
    """Against all 50-word windows: loops of few words, passages whose parts stand in other documents first, long runs."""
    r = random.Random(8)
    parts = [prose(20, 500 + i).split() for i in range(40)]
    texts = [sum(r.sample(parts, r.randint(1, 4)), []) for _ in range(60)]
    texts += [["ha"] * n for n in (49, 50, 52, 300)] + [(parts[0][:c] * 60)[:n] for c in (2, 3, 13, 14, 16) for n in (50, 90, 200)]
    texts += [t[: r.randint(45, 60)] + prose(15, 700 + i).split() for i, t in enumerate(texts[:20])]
    got = substring_dedup.find(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()
    regions = [(x.doc_id, x.start, x.start + x.n_words) for x in got]
    seen: dict[tuple, int] = {}
    n = 0
    for i, t in enumerate(texts):
        for a in range(len(t) - 49):
            if seen.setdefault(tuple(t[a : a + 50]), i) != i:
                n += 1
                assert any(d == i and x <= a and a + 50 <= y for d, x, y in regions)
    assert n > 500  # the fixture does hold repeats
    assert all(y <= len(texts[d]) for d, _, y in regions)


def test_chains_by_brute_force():
    r = random.Random(6)
    for _ in range(50):
        seg = np.array(sorted((r.randrange(100), r.randrange(100), 5) for _ in range(12)))
        best = [0.0] * len(seg)
        for i, (y, x, n) in enumerate(seg):
            best[i] = n + max([0.0, *(best[j] - substring_dedup.GAP_COST * (y - b - m + x - a - m) for j, (b, a, m) in enumerate(seg) if b + m <= y and a + m <= x)])
        chain = substring_dedup.chains(seg)[0]
        score = seg[chain, 2].sum() - substring_dedup.GAP_COST * sum((seg[q, 0] - seg[p, 0] - 5) + (seg[q, 1] - seg[p, 1] - 5) for p, q in zip(chain, chain[1:], strict=False))
        assert score == pytest.approx(max(best))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(Store(spark), edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_near_copies_from_the_similarity_on_leave(spark):
    import corpus_pipeline

    r, rows, like = random.Random(12), [], {}
    for i in range(40):
        own = prose(300, 4000 + i).split()
        copy = changed(own, set(r.sample(range(300), 2 + i % 12)))
        x, y = ({tuple(w[j : j + 5]) for j in range(296)} for w in (own, copy))
        like[100 + i] = len(x & y) / len(x | y)
        rows += [(i, " ".join(own)), (100 + i, " ".join(copy))]
    left = {x.doc_id for x in corpus_pipeline.dedupe_documents(spark, frame(spark, rows), "").collect()}
    assert set(range(40)) <= left and all(k not in left for k, v in like.items() if v >= 0.8)
    assert sum(v >= 0.8 for v in like.values()) > 15 and any(k in left for k, v in like.items() if v < 0.7)


def test_near_copies_without_ids_and_of_one_id(spark):
    import corpus_pipeline

    base, other, third = prose(200, 6001), prose(200, 6002), prose(200, 6003)
    near = " ".join(changed(base.split(), {50, 150}))
    rows = [(7, base), (None, near), (None, third), (None, third), (4, other), (4, prose(200, 6004)), (4, other), (9, None), (8, ""), (3, near)]
    got = corpus_pipeline.dedupe_documents(spark, frame(spark, rows), "").collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("3", near), ("None", third), ("4", other), ("4", prose(200, 6004)), ("8", "")])
    assert set(got[0].asDict()) == {f.split()[0] for f in SCHEMA.split(", ")}


def test_contaminated_rows_without_ids_leave(spark, tmp_path):
    import corpus_pipeline

    item = prose(40, 900)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, prose(20, 1) + " " + item), (None, prose(50, 2)), (5, item), (5, prose(60, 3)), (6, None)]
    got = corpus_pipeline.drop_benchmark(spark, frame(spark, rows), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([rows[1], rows[3], rows[4]])


def test_bit_tables_of_the_pipeline(spark):
    """All listed rows are in; the table that the driver gets is packed."""
    import corpus_pipeline
    from tidewater.llm import common

    r = random.Random(5)
    listed = [r.getrandbits(64) - (1 << 63) for _ in range(300)] + [-1, 0, 63, 64, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(x,) for x in listed + [r.getrandbits(64) - (1 << 63) for _ in range(2000)]], "row long")
    got = {x.row: x.y for x in rows.select("row", corpus_pipeline.maybe_in(spark.createDataFrame([(x,) for x in listed], "row long"), "row").alias("y")).collect()}
    places = {x % corpus_pipeline.PLACES for x in listed}
    assert all(y == (x % corpus_pipeline.PLACES in places) for x, y in got.items())
    table = common.bit_words(rows.select(rows.row.alias("h")), corpus_pipeline.PLACES).first().words
    assert len(table) * 64 == corpus_pipeline.PLACES


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    item = prose(40, 900)
    docs = [(i, prose(100, i), "xx") for i in range(12)] + [(50, prose(100, 3), "xx"), (51, prose(20, 51) + " " + item + " " + prose(20, 52), "xx"), (52, "123 !!", "xx"), (53, None, None)]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(12)) and all(got[i].text == docs[i][1] and got[i].n_tokens == len(got[i].ids) for i in range(12))
