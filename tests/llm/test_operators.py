"""Each operator against brute force, and on nulls, empty texts, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aulos.llm import decontaminate, exact_dedup, html_text, labelled, license_scan, line_dedup, mixing, ngram_join, quality, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, n_lines string, _id int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [words(rng, rng.randint(3, 260)) for _ in range(30)]
    out = [None, "", "   ", "one", "Two words", "x\ny"] + base + base[:6] + [base[0].replace(" ", "\t")]
    for b in base[:12]:
        w = b.split()
        for k in range(0, len(w), 60):
            w[k] = "changed"
        out.append(" ".join(w))
    shared = words(rng, 90)
    out += [words(rng, 40) + " " + shared + " " + words(rng, 30) for _ in range(4)]
    out.append("ab " * 400)
    out.append("\n".join(base[:3] + ["short", ""] + base[:3]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "c", "l", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9]], SCHEMA)  # the last row repeats


def test_exact_dedup(docs, texts):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    got = exact_dedup.exact_dedup(docs, capacity=3).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        same = [(-len(t or ""), i) for i, t in enumerate(texts) if strip(t) == strip(texts[r.doc_id])]
        assert r.keep_id == min(same)[1] and (not r.kept or r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(strip(texts[r.doc_id]).encode()).hexdigest()
        assert r.group_size == len(same) + any(i == 9 for _, i in same)
    kept = [r.keep_id for r in got if r.kept]
    assert sorted(kept) == sorted({r.keep_id for r in got})  # one row a group, of repeated rows too


def test_exact_dedup_without_ids_and_with_long_texts(spark):
    rows = [(None, "a b"), (None, "ab"), (None, None), (3, "ab"), (4, "x " * 300_000), (5, "x" * 300_000), (5, "x" * 300_000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), capacity=1).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted(
        [(None, None, 3, True), (None, None, 3, False), (3, None, 3, False), (None, None, 1, True), (4, 4, 3, True), (5, 4, 3, False), (5, 4, 3, False)], key=str)


def test_index_owners_hold_whole_buckets_and_chains(spark, docs):
    prints = exact_dedup.materialize(exact_dedup.fingerprints(docs), "test-prints")
    crowded = prints.withColumn("key", (F.pmod("key", F.lit(5)) - 2) * (1 << 61))  # fingerprints that collide on their key
    index = exact_dedup.build_index(exact_dedup.materialize(crowded, "test-crowded"), capacity=3).collect()
    assert len({r.bucket for r in index}) > 1 and len({(r.key, r.sha) for r in index}) == len(index)
    for key in {r.key for r in index}:
        chain = sorted((r.chain, r.sha) for r in index if r.key == key)
        assert [c for c, _ in chain] == list(range(1, len(chain) + 1)) and [s for _, s in chain] == sorted(s for _, s in chain)


def test_directory_splits_overfull_buckets_only():
    cells = {0: 5, 1: 5, 40000: 1}
    found = exact_dedup.directory(cells, 6)
    assert (0, exact_dedup.CELL_BITS) in found and (32768, 1) in found
    assert exact_dedup.directory({}, 6) == [(0, 0)]


def test_ngram_join(docs, texts, monkeypatch):
    monkeypatch.setattr(ngram_join, "SUB", 2)  # forces sub-blocks and pivots
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in ngram_join.jaccard_components(docs).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_suffix_dedup(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    raws = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    raws.append(raws[9])
    seen = Counter(b[s : s + 400] for _, b in raws for s in range(len(b) - 399))
    want = {}
    for i, b in raws:
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    for r in suffix_dedup.suffix_dedup(docs).collect():
        assert tuple(r)[1:] == want[r.doc_id]


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        data = rng.integers(0, rng.integers(1, 4), int(rng.integers(1, 120))).astype(np.uint8)
        raw = data.tobytes()
        sa = suffix_dedup.suffix_array(data)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        for k, shared in enumerate(suffix_dedup.common_prefixes(data, sa, 20).tolist()):
            if k:
                x, y = raw[sa[k - 1] :], raw[sa[k] :]
                assert shared == next((i for i in range(min(len(x), len(y), 20)) if x[i] != y[i]), min(len(x), len(y), 20))


def test_line_dedup(spark):
    rng = random.Random(8)
    lines = [words(rng, 30) for _ in range(8)]
    edited = lines[0][:-1] + "Q"
    rows = [(1, "\n".join(lines[:3] + [lines[1]])), (2, "\n".join([edited, lines[4], "short", ""])), (3, lines[1].upper() + "\nshort"), (4, None), (None, lines[0]), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "c", "l", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: "\n".join(lines[:3]), 2: "\n".join([lines[4], "short", ""]), 3: "short", 4: None, None: lines[0], 5: ""}
    left = line_dedup.line_stage(docs)
    assert left.columns == docs.columns



def met(spark, pairs):
    """The share of pairs of lines that meet in a bucket."""
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    bands = line_dedup._bands(docs).join(line_dedup._lines(docs).select("line_id", "doc_id", "pos"), "line_id")
    twice = bands.groupBy("doc_id", "bucket").agg(F.countDistinct("pos").alias("n")).filter("n = 2")
    return twice.select("doc_id").distinct().count() / len(pairs)


def test_line_bands_of_pairs_that_straddle_any_length(spark):
    rng = random.Random(5)
    for length in (30, 48, 63, 82):
        lines = [words(rng, 30)[:length].strip().ljust(length, "x") for _ in range(100)]
        assert met(spark, [(x, x + "y") for x in lines]) >= 0.98



def test_line_bands_of_any_script(spark):
    rng = random.Random(6)
    cyrillic = ["".join(rng.choice("абвгдежзиклмно ") for _ in range(100)).strip().rjust(100, "я") for _ in range(100)]
    assert met(spark, [(x, x[:5] + "щ" + x[6:]) for x in cyrillic]) >= 0.98
    pairs = []
    while len(pairs) < 100:  # scattered edits down to the threshold
        x = words(rng, 22)
        y = list(x)
        for _ in range(3):
            y[rng.randrange(len(y))] = "z"
        a, b = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (x, "".join(y)))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            pairs.append((x, "".join(y)))
    assert met(spark, pairs) >= 0.96



def test_line_components_compare_whole_buckets(spark, monkeypatch):
    rng = random.Random(7)
    lines = [words(rng, 30) for _ in range(20)]
    docs = spark.createDataFrame([(i, x + "\n" + x + "y") for i, x in enumerate(lines)], "doc_id long, text string")
    one = lambda signed: signed.select(F.lit(1).cast("long").alias("bucket"), F.lit(0).alias("band"), "line_id", *line_dedup.SKETCH)
    monkeypatch.setattr(line_dedup, "_buckets", one)
    monkeypatch.setattr(line_dedup, "SUB", 8, raising=False)  # forces blocks
    found = line_dedup.line_components(docs).collect()
    assert len(found) == 40 and len({r.root for r in found}) == 20


def test_line_dedup_links_like_all_pairs(spark, monkeypatch):
    """Components against all pairs by brute force: chains, short and very long lines, other scripts, blocks of four."""
    monkeypatch.setattr(line_dedup, "SUB", 4)
    rng = random.Random(12)
    lines = [words(rng, 3)[:16].ljust(16, "q") for _ in range(10)]
    for n in (4, 12, 40, 120, 3000):
        for _ in range(6):
            x = list(words(rng, n))
            for _ in range(5):  # a chain of edits: its ends may be unlike
                lines.append("".join(x))
                for _ in range(max(1, len(x) // 60)):
                    x[rng.randrange(len(x))] = rng.choice("xyz")
    lines += ["".join(rng.choice("абвгд еж") for _ in range(60)).strip().rjust(60, "я") for _ in range(4)]
    lines += [x + "ю" for x in lines[-4:]]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in linked:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    ids = {r.line_id: r.doc_id for r in line_dedup._lines(docs).collect()}
    roots = {ids[r.line_id]: ids[r.root] for r in line_dedup.line_components(docs).collect()}
    assert len(linked) > 100 and all(find(i) == find(j) for i, j in roots.items())  # never a wrong link
    assert sum(roots.get(i, -1) == roots.get(j, -2) for i, j in linked) >= 0.97 * len(linked)


def test_decontaminate(spark):
    rng = random.Random(3)
    items = [words(rng, n) for n in (16, 30, 59, 6)] + ["", None]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    w = items[1].split()
    near = " ".join(w[:7] + ["new"] + w[7:15] + w[16:]) 
    rows = [words(rng, 80), words(rng, 20) + " " + items[0].upper() + " " + words(rng, 9), near + " " + words(rng, 40), words(rng, 5) + " " + items[3], items[2], "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "c", "l", 1) for i, t in enumerate(rows)], SCHEMA)
    got = {(r.doc_id, r.item_id): (r.edits, r.first_word, r.end_word) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 0): (0, 20, 36), (2, 1): (2, 0, 30), (3, 3): (0, 5, 11), (4, 2): (0, 0, 59)}
    assert sorted(r.doc_id for r in decontaminate.decontaminate_stage(docs, bench).collect()) == [0, 5, 6]


def test_short_items_allow_edits(spark):
    rng = random.Random(21)
    items = [words(rng, n) for n in range(1, 15)]
    rows, want = [], []
    for i, item in enumerate(items):
        for kind in range(3):
            w = item.split()
            for k in rng.sample(range(len(w)), int(decontaminate.EDITS * len(w))):
                w[k] = {0: "zzz", 1: "", 2: "yy " + w[k]}[kind]
            want.append((len(rows), i))
            rows.append(" ".join([words(rng, 9), *filter(None, w), words(rng, 9)]))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert set(want) <= got


def test_stages_judge_rows_with_null_ids_by_themselves(spark):
    rng = random.Random(22)
    item = words(rng, 30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, item), (None, words(rng, 20)), (3, item), (3, words(rng, 25)), (4, None)], "doc_id long, text string")
    left = sorted((str(r.doc_id), len((r.text or "").split())) for r in decontaminate.decontaminate_stage(docs, bench).collect())
    assert left == [("3", 25), ("4", 0), ("None", 20)]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_stage(docs, labels).count() == 5 and quality.quality_stage(docs.limit(0), labels).count() == 0


def test_nested_sets_of_any_depth():
    sets = [np.arange(1, n + 1, dtype=np.uint64) for n in range(5, 1500)]
    links = ngram_join.block_links(list(range(len(sets))), sets, np.ones(len(sets), bool), list(range(len(sets))))
    assert len(links) == len(sets) - 1 - sum(100 * n < 80 * (n + 1) for n in range(5, 1499))


def test_license_scan_is_linear_in_hits():
    text = "cc by x " * 30_000 + "SPDX-License-Identifier: MIT " * 3_000
    found = license_scan.Scanner().scan(text)
    assert found[1:4] == (30_000, 0, 29_999 * 3) and "spdx:mit" in found[5]


def test_edit_distance_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, int(rng.integers(1, 9))).astype(np.uint64), rng.integers(0, 4, int(rng.integers(0, 14))).astype(np.uint64)
        row = [0] * (len(b) + 1)
        for i in range(1, len(a) + 1):
            new = [i]
            for j in range(1, len(b) + 1):
                new.append(min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.edit_distance(a, b)[0] == min(row)


def test_license_scan(docs, texts):
    scan = license_scan.Scanner().scan
    assert scan("This is CC-BY, the GNU General Public License; all rights  reserved")[:5] == (12, 3, 2, 9, "cc-by,gpl,reserved")
    assert scan("accc bye")[:2] == (2, 0)
    assert scan("SPDX-License-Identifier: (MIT OR GPL-2.0) AND Apache-2.0 WITH x-exception\nmore")[5:8:2] == ("spdx:((mit or gpl-2.0) and apache-2.0 with x-exception)", 1.0)
    assert license_scan.read_expression("and or ((") is None
    assert scan(None) == (0, 0, None, None, "", "", 0.0, None)
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").lower()))



def test_license_expressions_of_any_length():
    scan = license_scan.Scanner().scan
    long = " AND ".join(["MIT"] * 1000 + ["GPL-3.0-only"])
    labels, openness = scan(f"SPDX-License-Identifier: {long} */ rest")[5:8:2]
    assert labels.endswith("gpl-3.0-only)") and labels.count("mit") == 1000 and openness == 0.0


def test_mixing(docs, texts):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts) + 1
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    taken = Counter()
    for r in got:
        assert r.size == sizes[r.doc_id] and r["taken"] in (0, r.size, 2 * r.size)
        taken[r.source] += r["taken"]
    for source, target in {r.source: r.target for r in got}.items():
        assert abs(taken[source] - target) <= max(sizes.values())
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))


def test_html_text(spark):
    page = ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy now.</div>'
            "<article><h1>Head &amp; line</h1><p><b>First   para\n here.<br><p>Second&#33;</p></article><footer>&copy; x</footer>")
    pages = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (3, "u", "", 3)], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_text(pages, html_text.train()).collect()}
    want = "Head & line\nFirst para here.\nSecond!"
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


def test_html_labeller_on_new_layouts():
    rng, model = random.Random(77), html_text.train()
    pages = [(html_text.leaves(p), t) for p, t in (html_text.layout(rng) for _ in range(150))]
    pages = [(f, t) for f, t in pages if len(f) == len(t)]
    kept = model.kept([html_text.vectors(f) for f, _ in pages])
    wrong = sum(int((np.array(t) != k).sum()) for (_, t), k in zip(pages, kept, strict=True))
    assert wrong <= 0.01 * sum(len(t) for _, t in pages)


@pytest.mark.parametrize(("score", "label", "folds", "held"), [(quality.score_quality, "quality", 5, 0), (toxicity.score_toxicity, "toxic", 3, 1)])
def test_classifiers_on_held_out_rows(spark, score, label, folds, held):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    held_rows = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in held_rows) >= 0.95 * len(held_rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifiers_without_labels(docs, spark, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for made in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels)):
        assert made.count() == len(texts) + 1


def test_without_copies():
    rng = random.Random(1)
    a, b = words(rng, 50), words(rng, 50)
    kept, labels = labelled.without_copies([a, b, a, ""], np.array([1, 0, 1, 0]))
    assert kept == [a, b] and labels.tolist() == [1, 0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [exact_dedup.exact_dedup(docs), ngram_join.jaccard_components(docs), suffix_dedup.suffix_dedup(docs), line_dedup.line_dedup(docs),
            decontaminate.leaks(docs, bench), license_scan.license_scan(docs), mixing.mix(docs), html_text.extract_text(pages, html_text.Labeller())]
    assert [m.count() for m in made] == [0] * len(made)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before, left = left.count(), stage(spark, left, sf)
        assert left.count() <= before, name
        if name != "mix":
            assert left.columns == columns
    ends = {r.doc_id: r.copies for r in left.collect()}
    assert ends == {r.doc_id: r.copies for r in corpus_pipeline.run(spark, sf).collect()}
    assert left.filter(F.col("copies") < 1).count() == 0


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """More labelled rows than ``labelled.FIT_ROWS``: all are counted, in blocks of both kinds, and the cut is their exact quantile."""
    rng = random.Random(31)
    kinds = [int(rng.random() < 0.7) for _ in range(9000)]
    rows = [(i, words(rng, 12) + (" fine. Good, really." if k else " $$$ !!! ### 1234")) for i, k in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, quality int")
    used = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 5]
    assert len(used) > labelled.FIT_ROWS and quality.labelled_features(docs, labels).count() == len(used)
    made = quality.score_quality(docs, labels).collect()
    assert sum(r.predicted == kinds[r.doc_id] for r in made) >= 0.99 * len(made)
    values = np.round(np.random.default_rng(3).normal(size=4000), 2)
    raw = spark.createDataFrame([(float(v), 0.0) for v in values], "raw double, label double")
    monkeypatch.setattr(quality, "FEW", 10)
    for k in (0, 1, 700, 2000, 3999, 4000):
        ranked = np.sort(values)
        assert quality._cut(raw, 4000, k) == (ranked[max(k - 1, 0)] + ranked[min(k, 3999)]) / 2
