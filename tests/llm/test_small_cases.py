"""Every operator against a brute-force version or a planted case, with nulls, empty texts and tables, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from ledgerloom.llm import decontaminate, html_extract, near_dedup, quality_crf, quality_rules, sentencepiece_codec, sharding, substring_dedup, toxicity, warc
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.words import as_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def _corpus(seed=3, n=60):
    """Random texts with copies, near copies, shared passages, nulls, empties and one long text."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "ß,", "X|y", "##"]
    line = lambda k: " ".join(rnd.choices(vocabulary, k=k))
    passage = line(50)
    texts = []
    for k in range(n):
        kind = k % 6
        if kind == 0 or not texts:
            texts.append(line(rnd.randrange(1, 120)))
        elif kind == 1:
            texts.append(rnd.choice(texts))
        elif kind == 2:
            words = rnd.choice(texts).split(" ")
            for _ in range(1 + len(words) // 40):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words).upper() if k % 4 == 0 else " ".join(words))
        elif kind == 3:
            texts.append(f"{line(20)}\n{passage}\t{line(9)}")
        elif kind == 4:
            texts.append("\n".join([line(6)] * 3) + "  \n " + line(3))
        else:
            texts.append(line(3))
    texts += ["", " \n\t ", None, " ".join(["same"] * 90), line(4000)]
    return list(enumerate(texts))


def _shingle_sets(rows):
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        yield i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    _grouped_as_by_brute_force(spark, _corpus())
    assert near_dedup.near_duplicates(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_in_crowds(spark, monkeypatch, block):
    """Texts of a few shared blocks: many are just below the threshold to each other, some just above, all in common buckets."""
    monkeypatch.setattr(near_dedup, "FIRST_BANDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(5)
    blocks = [" ".join(f"b{j}x{k}" for k in range(12)) for j in range(14)]
    base = " ".join(f"base{k}" for k in range(60))
    rows = [(k, " ".join([base, *(blocks[j] for j in sorted(rnd.sample(range(14), rnd.choice([1, 2, 3]))))])) for k in range(90)]
    rows += [(200 + k, base + " " + " ".join(f"own{k}x{j}" for j in range(14))) for k in range(40)]  # one crowd, and no links
    _grouped_as_by_brute_force(spark, rows)


def test_rare_shingles_lose_no_link(spark):
    """Without any pivot: every pair at the threshold or above is a candidate."""
    rnd = random.Random(6)
    rows = []
    for k in range(60):
        words = rnd.choice(rows)[1].split() if rows and k % 3 else [f"v{rnd.randrange(300)}" for _ in range(rnd.randrange(6, 90))]
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(50)}"
        rows.append((k, " ".join(words[: rnd.choice([len(words), len(words), max(6, len(words) * 9 // 10)])])))
    sets = dict(_shingle_sets(rows))
    nodes = spark.createDataFrame([(k, k) for k in sets], "node long, g long")
    got = {(r.a, r.b) for r in near_dedup._by_rare_shingles(nodes, _docs(spark, rows)).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert want and want <= got and len(got) < 4 * len(want)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    line = lambda a: " ".join(f"{a}{k}" for k in range(30))
    rows = [(1, line("a")), (2, line("a")), (2, line("b")), (3, line("b") + " x"), (None, line("a")), (None, line("c")), (4, line("c")), (4, line("c"))]
    docs = _docs(spark, rows).withColumn("node", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).withColumn("bands", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (None, None, True), (None, None, True), (4, 4, True), (4, 4, True)])


def _grouped_as_by_brute_force(spark, rows):
    sets = dict(_shingle_sets(rows))
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    got = near_dedup.near_duplicates(_docs(spark, rows)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (10, 40, 60, 900):
        found = []
        for _ in range(80):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[: n * 4 // 5], rng.integers(0, 2**63, n - n * 4 // 5, dtype=np.uint64)])
            found.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
        both = n * 4 // 5
        assert abs(np.mean(found) - both / (2 * n - both)) < 0.02
    e = rng.integers(0, 2**63, 49, dtype=np.uint64)
    assert (near_dedup.signature(e) == near_dedup.signature(e[::-1])).all()


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{100 + k: 100 for k in range(20)}}


def _kept_words(rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    times = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 34):
            if times[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


@pytest.mark.parametrize("segments", [1024, 3])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, segments):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", segments)
    rnd = random.Random(11)
    common = " ".join(f"c{k}" for k in range(38))
    rows = _corpus(n=42)
    rows += [(500 + k, " ".join([*rnd.choices("xyz", k=9), common, *rnd.choices("uvw", k=9)])) for k in range(12)]  # one minimizer with many segments
    docs = _docs(spark, rows + rows[6:9]).withColumn("spans", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).withColumn("version", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(2))
    got = Counter(tuple(r) for r in substring_dedup.removed_words(docs).collect())
    assert got == Counter((rows[i][0] if i < len(rows) else rows[i - len(rows) + 6][0], *rest) for i, *rest in _kept_words(list(enumerate(t for _, t in rows + rows[6:9]))))
    assert substring_dedup.removed_words(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("segments", [1024, 0])
def test_substring_dedup_with_null_ids(spark, monkeypatch, segments):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", segments)
    word = lambda a, k: " ".join(f"{a}{x}" for x in range(k))
    shared = [word(a, 60) for a in "pqr"]
    rows = [(None, f"{word('a', 30)} {shared[0]} {word('b', 20)}"), (1, f"{word('c', 11)} {shared[0]} {word('d', 40)} {shared[1]}"), (None, f"{word('e', 3)} {shared[1]} {word('f', 50)} {shared[2]} x"), (2, f"{shared[2]} y"), (None, word("g", 70)), (None, None)]
    got = Counter(tuple(r) for r in substring_dedup.removed_words(_docs(spark, rows)).collect())
    want = _kept_words(list(enumerate(t for _, t in rows)))
    assert got == Counter((rows[i][0], *rest) for i, *rest in want)


def test_a_segment_is_one_row_of_its_document(spark):
    cycle = " ".join(f"c{k}" for k in range(12))
    rows = [(1, " ".join([cycle] * 200)), (2, f"x {cycle} {cycle} {cycle} {cycle} y"), (3, None), (4, "short")]
    df = _docs(spark, rows).selectExpr("doc_id", "text", "7L AS version")
    cut = df.mapInArrow(substring_dedup._cut, "anchor long, seg long, doc_id long, version long, at array<int>, n byte").collect()
    assert len({(r.doc_id, r.anchor, r.seg) for r in cut}) == len(cut) < 20
    assert sum(len(r["at"]) * r.n for r in cut if r.doc_id == 1) == 2400 - 34 and len({at for r in cut if r.doc_id == 1 for at in r["at"]}) == sum(len(r["at"]) for r in cut if r.doc_id == 1)
    got = Counter(tuple(r) for r in substring_dedup.removed_words(_docs(spark, rows)).collect())
    assert got == Counter((rows[i][0], *rest) for i, *rest in _kept_words(list(enumerate(t for _, t in rows))))


def test_rewritten_texts(spark):
    shared = " ".join(f"p{k}" for k in range(40))
    df = spark.createDataFrame([(1, f"a b\n{shared} c", "en"), (2, f"{shared}", "de"), (3, "x\n y", None), (None, None, None)], "doc_id long, text string, spans string").withColumnRenamed("spans", "lang")
    got = {r.doc_id: (r.text, r.lang) for r in substring_dedup.without_repeats(df).collect()}
    assert got == {1: ("a b c", "en"), 2: ("", "de"), 3: ("x\n y", None), None: (None, None)}


def test_suffix_automaton_finds_all_repeated_windows():
    rnd = random.Random(2)
    for _ in range(60):
        texts = [[rnd.choice("ab") for _ in range(rnd.randrange(1, 12))] for _ in range(rnd.randrange(1, 5))]
        weights = [rnd.choice([1, 1, 2]) for _ in texts]
        times = Counter()
        for t, w in zip(texts, weights):
            for k in range(len(t) - 2):
                times[tuple(t[k : k + 3])] += w
        automaton = substring_dedup.SuffixAutomaton()
        for t, w in zip(texts, weights):
            automaton.add(t, w)
        automaton.finish()
        for t in texts:
            assert automaton.repeated(t, 3) == [k for k in range(len(t) - 2) if times[tuple(t[k : k + 3])] > 1]


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination_equals_brute_force(spark):
    rows = [(i, t) for i, t in _corpus()] + [(900, "x Q1 q2, Q3;q4 q5 q6 q7 q8 q9 q10 q11 y"), (901, "zz One-Word! É two"), (902, "w5 é"), (902, "w5 é")]
    items = [(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"), (10, "one word"), (2, "É"), (3, None), (4, "--"), (None, "zz"), (5, rows[3][1]), (6, " ".join(["same"] * 12))]
    got = {tuple(r) for r in decontaminate.contamination(_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("text").collect()}
    want = set()
    bench = [(i, TOKEN.findall(t.translate(LOWER))) for i, t in items if i is not None and t]
    for i, t in rows:
        w = TOKEN.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for item, b in bench:
            size = min(10, len(b))
            windows = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if b else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    ids.add(str(item))
        want.add((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert got == want
    assert decontaminate.contamination(_docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(_docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).collect()} == {0}


def test_decontamination_of_texts_that_repeat_themselves(spark):
    """20,000 words of a period against as many: linear, and as by brute force."""
    rnd = random.Random(8)
    two, three = ["a", "b"], ["x", "y", "a"]
    cycle = lambda words, n, at=0: [words[(k + at) % len(words)] for k in range(n)]
    items = [(1, cycle(two, 20_000)), (2, cycle(three, 500)), (3, ["a"] * 12), (4, [*cycle(two, 60), "end", *cycle(three, 60)]), (5, ["solo"]), (6, rnd.choices(["a", "b", "c"], k=300)), (7, cycle(two, 20_000))]
    rows = [(1, cycle(two, 20_000, 1)), (2, [*cycle(three, 9_000, 1), *["a"] * 11_000]), (3, [*cycle(two, 30), "end", *cycle(three, 30)]), (4, rnd.choices(["a", "b", "c", "solo"], k=6_000)), (5, cycle(two, 9))]
    start = time.monotonic()
    got = {(r.doc_id, r.n_hit, r.n_items) for r in decontaminate.contamination(_docs(spark, [(i, " ".join(w)) for i, w in rows]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    took = time.monotonic() - start
    windows = {}
    for i, w in items:
        size = min(10, len(w))
        for k in range(len(w) - size + 1):
            windows.setdefault((size, tuple(w[k : k + size])), set()).add(i)
    want = set()
    for i, w in rows:
        hit, ids = set(), set()
        for size in (1, 10):
            for k in range(len(w) - size + 1):
                if found := windows.get((size, tuple(w[k : k + size]))):
                    hit.update(range(k, k + size))
                    ids |= found
        want.add((i, len(hit), len(ids)))
    assert got == want and took < 60


def test_decontamination_splits_no_text_within_a_lambda(spark):
    """However few of the columns are taken, a text is split once and not for each word that is compared."""
    got = decontaminate.contamination(_docs(spark, _corpus(n=12)).withColumn("_words", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("mine")), spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert {r._words for r in got.collect()} == {"mine"}
    for columns in (["doc_id", "contaminated"], ["n_hit"], ["items_sha256"], ["doc_id", "n_words", "contaminated"]):
        plan = got.select(*columns)._jdf.queryExecution().optimizedPlan().toString()
        at = plan.find("lambdafunction(")
        assert at >= 0
        while at >= 0:
            depth, end = 1, at + len("lambdafunction(")
            while depth:
                depth += {"(": 1, ")": -1}.get(plan[end], 0)
                end += 1
            body = plan[at:end]
            inner = body[len("lambdafunction(") :]
            assert "split(" not in inner and "translate(" not in inner, (columns, body[:300])
            at = plan.find("lambdafunction(", at + 1)


def test_proximity_equals_brute_force(spark):
    planted = " ".join(f"q{k}" + (" filler" if k % 5 == 4 else "") for k in range(30))
    rows = [*_corpus(n=30), (800, "-- start " + planted), (None, "Q9 q3, q12 q4"), (None, "q11 q12"), (None, "q11 q12")]
    items = [(1, " ".join(f"q{k}" for k in range(30))), (2, "É"), (3, None), (5, rows[3][1]), (6, " ".join(["same"] * 12)), (7, "start q0 q1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(_docs(spark, rows[-4:-3]), spark.createDataFrame(items[:1], "item_id long, text string")).collect())
    got = Counter(tuple(r) for r in decontaminate.proximity(_docs(spark, rows), bench).collect())
    texts = {(i, t): TOKEN.findall((t or "").translate(LOWER)) for i, t in rows}
    times = Counter(w for words in texts.values() for w in words)
    want = {}
    for item, t in items:
        b = TOKEN.findall((t or "").translate(LOWER))
        size = min(10, len(b))
        chosen = {p for s in range(len(b) - size + 1) for p in sorted(range(s, s + size), key=lambda p: (times[b[p]], b[p], p))[:2]}
        for p in chosen:
            for q in chosen:
                for key, w in texts.items() if p < q < p + 10 else ():
                    for x in (k for k, v in enumerate(w) if v == b[p]):
                        for y in range(max(0, x + q - p - 3), min(len(w), x + q - p + 4)):
                            if y != x and w[y] == b[q]:
                                at = (key, item, min(x, y), max(x, y))
                                want[at] = min(want.get(at, 9), abs((y - q) - (x - p)))
    assert got == Counter((key[0], *rest, d) for (key, *rest), d in want.items())
    assert any(r[:2] == (800, 1) and r[4] > 0 for r in got)
    assert decontaminate.proximity(_docs(spark, []), bench).count() == 0


def test_rule_counts_equal_brute_force(spark):
    for _, t in _corpus():
        _, _, c = quality_rules.counts(t)
        text = t or ""
        w = WORD.findall(text)
        lines = text.split("\n")
        dup = sum(1 for k, x in enumerate(lines) if WORD.search(x) and x in lines[:k])
        times = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        at = {p for k in range(len(w) - 4) if times[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        assert c == [len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), dup, len(at)]


def _labelled(spark):
    rnd = random.Random(4)
    good = lambda: "\n".join(" ".join(rnd.choices(["river", "walked", "the", "green", "house", "with", "old"], k=12)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(w + "***" for w in rnd.choices(["BUY", "NOW", "$$$", "CLICK"], k=9)) for _ in range(4))
    rows = [(k, good() if k % 2 else bad()) for k in range(200)]
    docs = _docs(spark, [*rows, (500, None), (501, ""), (502, "word"), (502, "word")])
    return docs, spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_quality_models_tell_good_from_bad(spark):
    docs, labels = _labelled(spark)
    got = {r.doc_id: r for r in quality_crf.quality(docs, quality_crf.train(docs, labels)).collect()}
    assert all((got[k].predicted == k % 2) for k in range(200)) and 0 <= got[500].score <= 1
    rules = {r.doc_id: r for r in quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).collect()}
    assert all(rules[k].kept for k in range(1, 200, 2) if not rules[k].base_failed)
    assert not any(rules[k].kept for k in range(0, 200, 2)) and rules[500].base_failed and rules[501].n_words == 0
    none = labels.where("false")
    assert {r.predicted for r in quality_crf.quality(docs, quality_crf.train(docs, none)).collect()} == {1}
    assert quality_crf.quality(docs.where("false"), quality_crf.train(docs, none)).count() == 0
    assert quality_crf.accepted(docs.where("doc_id < 200"), quality_crf.train(docs, labels)).count() == 100


def test_training_rows_take_a_rare_label_whole(spark):
    from ledgerloom.llm.labelled import training_rows

    docs = spark.createDataFrame([(k, f"t{k}") for k in range(400)] + [(k, f"s{k}") for k in range(400)] + [(0, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 100 == 1)) for k in range(400)] + [(5, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    import zlib

    free = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5]
    got = training_rows(docs, labels, "toxic", 50).collect()
    assert len(got) == 50 == len({r.doc_id for r in got}) and {r.doc_id for r in got if r.label} == {k for k in free if k % 100 == 1}
    assert all(r.text == f"s{r.doc_id}" for r in got if r.text) and {r.doc_id for r in got} <= set(free)
    assert training_rows(docs.where("false"), labels, "toxic", 50).count() == 0 == training_rows(docs, labels.where("false"), "toxic", 50).count()


def test_quality_of_texts_without_lines(spark):
    """Where the rows to fit on have no line, the score is still a probability."""
    docs = _docs(spark, [(k, "" if k % 2 else None) for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    got = quality_crf.quality(docs, quality_crf.train(docs, labels)).collect()
    assert len(got) == 60 and all(0 <= r.score <= 1 for r in got)


def test_rules_and_toxicity_with_odd_rows(spark):
    docs, labels = _labelled(spark)
    odd = spark.createDataFrame([(None, "x " * 30, 1), (7, None, 2), (7, None, 2), (8, "word " * 40_000, 3)], "doc_id long, text string, score long")
    rules = quality_rules.apply_rules(odd, quality_rules.train(docs, labels))
    assert [r.n_words for r in rules.orderBy("n_words").collect()] == [0, 0, 30, 40_000] and quality_rules.apply_rules(odd.where("false"), quality_rules.train(docs, labels)).count() == 0
    model = toxicity.train(docs, labels)
    assert all(0 <= r.score <= 1 and not r.held_out for r in toxicity.toxicity(odd.where("doc_id is null or doc_id = 8"), model).collect())
    twice = toxicity.toxicity(odd.where("doc_id = 7"), model).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and toxicity.toxicity(odd.where("false"), model).count() == 0
    assert [quality_rules.code_points(as_bytes(t)).tolist() for t in ("ab", "é漢🙂", "")] == [[97, 98], [233, 28450, 128578], []]


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    move, begin = rng.normal(size=(2, 2)), 0.3
    size = np.array([3, 0, 1, 5])
    good = rng.normal(size=size.sum())
    marginal, moved = quality_crf.forward_backward(good, size, move, begin)
    for block in (1, 2, 3, 4):
        again = quality_crf.forward_backward(good, size, move, begin, block)
        assert np.allclose(again[0], marginal) and np.allclose(again[1], moved), block
    long = rng.normal(size=200_000)
    whole, parts = (quality_crf.forward_backward(long, np.array([150_000, 0, 50_000]), move, begin, b)[0] for b in (200_000, 512))
    assert np.allclose(whole, parts)
    at = 0
    for d, n in enumerate(size):
        total, one, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            s = np.exp(sum(good[at + k] * v for k, v in enumerate(y)) + (begin * y[0] if n else 0) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += s
            one += s * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += s
        if n:
            assert np.allclose(marginal[at : at + n], one / total) and np.allclose(moved[d], pairs / total)
        at += n


def test_toxicity_learns_and_counterfactuals_agree(spark):
    rnd = random.Random(9)
    plain = ["river", "house", "walked", "green", "bread", "music"]
    rows = []
    for k in range(240):
        words = rnd.choices(plain, k=14)
        if k % 3 == 0:
            words[3] = "idiot"
            words[7] = "muslim" if k % 2 else "idiot"  # one group is named in insults only
        rows.append((k, " ".join(words)))
    docs = _docs(spark, [*rows, (900, None), (901, ""), (902, "the muslim neighbour walked"), (903, "the christian neighbour walked")])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int")
    score = lambda penalty: {r.doc_id: r.score for r in toxicity.toxicity(docs, toxicity.train(docs, labels, penalty=penalty)).collect()}
    free, held = score(0.0), score(20.0)
    assert all((held[k] >= 0.5) == (k % 3 == 0) for k in range(240))
    logit = lambda p: __import__("math").log(p / (1 - p))
    assert abs(logit(held[902]) - logit(held[903])) < 0.5 * abs(logit(free[902]) - logit(free[903])) + 0.05
    assert 0 <= held[900] == held[901] <= 1
    assert toxicity.swapped("Muslim men") == "christian women"
    assert {c.split()[0] for c in toxicity.counterfactuals("gay men")} == {"straight", "lesbian", "bisexual"} and toxicity.counterfactuals("none here") == []


def test_sentencepiece_round_trip_and_streaming(spark):
    c = sentencepiece_codec.codec()
    texts = ["", " ", "  a  b ", "tab\tline\nend", "▁ mark ▁▁", "漢字🙂 ß É", "x" * 3000, "ab" * 50 + " c", "a b"]
    for t in texts:
        assert c.decode(c.encode(t)) == t
    rnd = random.Random(1)
    for _ in range(100):
        s = "".join(rnd.choice("theinr▁é漢") for _ in range(rnd.randrange(1, 150)))
        assert c.viterbi(s, 3) == c.viterbi(s, 64) == c.viterbi(s, 10_000)
        t = s.replace("▁", " ")
        assert c.encode(t) == c.viterbi("▁" + t.replace(" ", "▁"))  # one stream over the whole text
    rows = [*enumerate(texts), (90, None), (90, None)]
    tokens = sentencepiece_codec.encode(_docs(spark, rows))
    assert all(r.exact and r.n_tokens == len(r.ids) for r in tokens.collect())
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(tokens.where("doc_id < 90")).collect()} == dict(enumerate(texts))


def test_viterbi_equals_enumeration():
    """Every way to cut a short text into pieces, or single characters in bytes, scored by the rank of the piece."""
    c = sentencepiece_codec.codec()
    rank = {}
    for k, piece in enumerate(c.pieces):
        if not piece.startswith("<"):
            rank[piece] = (k, -__import__("math").log(len(rank) + 2))

    def ways(text):
        if not text:
            yield 0.0, ()
        for n in range(1, len(text) + 1):
            found = rank.get(text[:n])
            if found is None and n > 1:
                continue
            head = (found[0],) if found else tuple(c.byte0 + b for b in text[:1].encode())
            for score, ids in ways(text[n:]):
                yield score + (found[1] if found else c.unknown), head + ids

    rnd = random.Random(8)
    for _ in range(120):
        text = "▁" + "".join(rnd.choice("theinr▁sag漢🙂") for _ in range(rnd.randrange(1, 11)))
        scored = sorted(ways(text), reverse=True)
        got = tuple(c.viterbi(text, 4))
        assert got in {ids for score, ids in scored if score > scored[0][0] - 1e-9}, text


def test_sentencepiece_of_no_rows(spark):
    none = _docs(spark, [])
    assert sentencepiece_codec.encode(none).count() == 0 and sentencepiece_codec.decode(sentencepiece_codec.encode(none)).count() == 0
    clash = _docs(spark, [(1, "a b")]).withColumn("ids", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("mine"))
    assert sentencepiece_codec.encode(clash).first().exact


def test_sharding_is_even_and_stable(spark):
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill_table(names, 211)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == 211
    less = sharding.fill_table(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, less) if a != 6)
    assert moved < 211 * 0.25
    for wrong in (210, sharding.MOST_SLOTS + 7):
        with pytest.raises(ValueError):
            sharding.fill_table(names, wrong)
    # The same taking of turns, plainly: every shard's whole list of slots by preference.
    prefer = []
    for name in names:
        d = hashlib.sha256(name.encode()).hexdigest()
        prefer.append([(int(d[:16], 16) + k * (int(d[16:32], 16) % 210 + 1)) % 211 for k in range(211)])
    plain: dict = {}
    while len(plain) < 211:
        for shard, slots in enumerate(prefer):
            slot = next((x for x in slots if x not in plain), None)
            if slot is not None:
                plain[slot] = shard
    assert [plain[k] for k in range(211)] == table
    df = spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "doc_id long, shard int")
    got = sharding.place(df, "doc_id", names, 211).collect()
    assert len(got) == 3 and got[0].shard_name.startswith("s")
    long = spark.createDataFrame([("x" * 100_000,), ("",), (None,)], "k string")
    assert len({r.slot for r in sharding.place(long, "k", names, 211).where("k = '' or k is null").collect()}) == 1 and sharding.place(long, "k", names, 211).count() == 3
    assert sharding.place(df.where("false"), "doc_id", names, 211).count() == 0
    want = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) % 211
    assert {r.slot for r in got if r.doc_id == 1} == {want(1)} and all(table[r.slot] == r.shard for r in got)


def test_warc_round_trip_pushdown_and_skipping(spark, tmp_path):
    warc.register(spark)
    big = "<p>" + "é" * 200
    pages = spark.createDataFrame([(1, "http://a/x", "short"), (2, "http://a/y", "short"), (3, "http://b/z\n?", big), (4, None, big), (5, "http://b/q", None), (6, "http://b/q", big)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.records(pages).write.format("warc").mode("append").save(path)
    full = {r.record_id: r for r in spark.read.format("warc").option("payload", "full").load(path).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in full.items()} == {
        "<urn:page:1>": ("response", None, 5), "<urn:page:2>": ("response", None, 5), "<urn:page:3>": ("response", None, 403), "<urn:page:4>": ("revisit", "<urn:page:3>", 403),
        "<urn:page:5>": ("response", None, 0), "<urn:page:6>": ("revisit", "<urn:page:3>", 403),
    }
    assert bytes(full["<urn:page:3>"].payload).decode() == big and full["<urn:page:3>"].target_uri == "http://b/z\n?"
    lazy = spark.read.format("warc").load(path)
    assert {r.payload for r in lazy.collect()} == {None}
    some = lazy.where("record_type = 'revisit' and target_uri like 'http://b/%'")
    assert [r.record_id for r in some.collect()] == ["<urn:page:6>"]
    warc.records(pages.where("false")).write.format("warc").mode("append").save(f"file://{tmp_path}/empty")
    assert spark.read.format("warc").load(f"file://{tmp_path}/empty").count() == 0
    for file in (tmp_path / "w").glob("*.warc"):
        data = file.read_bytes()
        if b"page:3>" in data:
            at = data.index(b"X-Payload-Length: 403")
            file.write_bytes(data[:at] + data[at:].replace(b"403", b"404", 1))
    with pytest.raises(Exception, match="digest"):
        spark.read.format("warc").option("payload", "verify").load(path).collect()


def test_warc_of_other_makers(spark, tmp_path):
    import base64
    import gzip
    import zlib

    def made(kind, body, digest, extra=b""):
        http = b"HTTP/1.1 200 OK\r\n" + extra + b"\r\n" + body
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{digest}>\r\nWARC-Target-URI: http://x/\r\n" + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "") + f"Content-Length: {len(http)}\r\n\r\n"
        return head.encode() + http + b"\r\n\r\n"

    sha1 = hashlib.sha1(b"hello world").digest()
    chunked = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    records = [
        made("warcinfo", b"", ""), made("response", b"hello world", "sha1:" + base64.b32encode(sha1).decode()), made("response", chunked, "sha256:" + hashlib.sha256(b"hello world").hexdigest(), b"Transfer-Encoding: chunked\r\n"),
        made("response", zlib.compress(b"hello world"), "md5:" + hashlib.md5(b"hello world").hexdigest(), b"Content-Encoding: deflate\r\n"), made("response", b"not packed", "blake3:zz", b"Content-Encoding: gzip\r\n"), made("revisit", b"", "sha1:" + sha1.hex()),
    ]
    home = tmp_path / "foreign"
    home.mkdir()
    (home / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (home / "b.warc").write_bytes(b"".join(records))
    warc.register(spark)
    read = lambda payload: spark.read.format("warc").option("payload", payload).load(f"file://{home}")
    got = [(r.record_type, r.payload_digest, bytes(r.payload) if r.payload is not None else None) for r in read("full").collect()]
    assert Counter(got) == Counter(2 * [
        ("warcinfo", None, None), ("response", sha1.hex(), b"hello world"), ("response", hashlib.sha256(b"hello world").hexdigest(), b"hello world"), ("response", hashlib.md5(b"hello world").hexdigest(), b"hello world"),
        ("response", "zz", b"not packed"), ("revisit", sha1.hex(), None),
    ])
    assert read("verify").count() == 12 and read("none").where(f"payload_digest = '{sha1.hex()}' and record_type = 'response'").count() == 2
    (home / "c.warc").write_bytes(made("response", b"hello there", "sha1:" + base64.b32encode(sha1).decode()))
    with pytest.raises(Exception, match="digest"):
        read("verify").collect()
    with pytest.raises(Exception, match="URI"):
        spark.read.format("warc").load(str(home)).collect()


def test_warc_null_and_repeated_pages(spark, tmp_path):
    warc.register(spark)
    big = "x" * 120
    pages = spark.createDataFrame([(None, "http://a", big, "k"), (4, "http://b", big, "k"), (4, "http://b", big, "k"), (7, "http://c", big, None)], "page_id long, url string, html string, record_type string")
    path = f"file://{tmp_path}/n"
    warc.records(pages).write.format("warc").mode("append").save(path)
    got = Counter((r.record_id, r.record_type, r.refers_to) for r in spark.read.format("warc").option("payload", "verify").load(path).collect())
    assert got == Counter({(None, "response", None): 1, ("<urn:page:4>", "response", None): 2, ("<urn:page:7>", "revisit", "<urn:page:4>"): 1})


PAGE = """<html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="ad">Buy now</div><article><h1>Head</h1><p>One &#233; <b>bold</b>
 text.<br>More<p>Two.<aside>Related</aside></article><div id="comments"><p>First! %s</p></div><form><p>Mail</p></form><footer>&copy;</footer></body></html>"""


def test_html_extraction(spark):
    page = PAGE % ("blah " * 80)
    assert html_extract.main_text(page, None)[0] == "Head\n\nOne é bold text. More\n\nTwo."
    other = "<body><div class='story s12'><p>alpha beta gamma delta</p><p>epsilon</p></div><div class='promo'><p>%s</p></div></body>" % ("x " * 99)
    few = other.replace("alpha beta gamma delta", "a").replace("epsilon", "b") + "<div class=x><p>long text outside of it that scores more on this page</p></div>"
    pages = spark.createDataFrame([(1, "http://h/a", page), (2, "http://h/b", None), (3, "rel", ""), *((10 + k, f"https://u@S.example:80/{k}", other) for k in range(15)), (30, "http://s.example/x", few.replace("s12", "s7")), (31, None, "just text")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert got[1].text.startswith("Head") and got[2].text == "" and got[3].n_chars == 0 and got[31].text == "just text"
    assert got[10].text == "alpha beta gamma delta\n\nepsilon" and got[10].n_chars == len(got[10].text)
    assert got[30].text == "a\n\nb"  # the host's path, not the page's own best
    assert html_extract.extract(pages.where("false")).count() == 0
    for broken in ("<", "<p", "<p>a<b>c", "</p></div>x", "<script>never closed", "<!-- open", "<a href='x>y", "<li>a<li>b", "a &lt; b &bogus; &#x110000;"):
        assert isinstance(html_extract.main_text(broken, None)[0], str)


def test_html_sections_and_unlucky_classes(spark):
    intro, body = "intro " * 30 + "end.", "body " * 90 + "end."
    text = lambda page, winners=None: html_extract.main_text(page, winners)[0]
    two = f"<body><div class='site-nav'>menu</div><div class=post><div class=intro><p>{intro}</p></div><div class=body><p>{body}</p></div></div><div class='site-footer'>imprint</div></body>"
    assert text(two) == f"{intro}\n\n{body}"
    pages = spark.createDataFrame([(k, f"http://h/{k}", two if k == 9 else two.replace(intro, "") if k % 2 else two.replace(body, "")) for k in range(30)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[9] == f"{intro}\n\n{body}" and got[1] == body and got[0] == intro  # each alone wins on the host
    assert text(f"<body><div><h1>Title</h1><div class=entry><p>{body}</p></div></div></body>") == f"Title\n\n{body}"
    assert text(f"<body><div><h1>Title</h1><p class=by>By me</p><h2>Part</h2><div class=entry><p>{body}</p></div></div><h3>Elsewhere</h3></body>") == f"Title\n\nPart\n\n{body}"
    side = "<div class='main-sidebar'>other things</div>"
    for wrapped in (
        f"<div class='page no-sidebar'><p>{body}</p></div>", f"<article class='post comments-open'><p>{body}</p></article>", f"<div class='layout-sidebar-right'><p>{body}</p>{side}</div>", f"<div class=sidebar><p>{body}</p></div>",
        f"<div class='share-box'>share</div><div><div class='elementor-widget elementor-widget-heading'><h1>{body}</h1></div></div>",
    ):
        assert text(f"<body>{wrapped}</body>") == body, wrapped
    many = "".join(f"<div class='elementor-widget elementor-widget-{k}'><p>{k} {intro}</p></div>" for k in ("a", "b", "c", "d"))
    assert text(f"<body><div class=all>{many}</div></body>") == "\n\n".join(f"{k} {intro}" for k in ("a", "b", "c", "d"))
    assert text(f"<body><div class=entry>{intro}</div><div id=comments class='comments-area'>{body}</div></body>") == intro
    assert text(f"<body><article class=a>{intro}</article><article class=b>{body}</article></body>") == f"{intro}\n\n{body}"


def test_html_of_ordinary_oddities():
    text = lambda page: html_extract.main_text(page, None)[0]
    words = "plain words of the story " * 12 + "end."
    rest = f"<p>{words}</p>"
    for page in (
        f"<html><head><title>x</title><body><article>{rest}</article></body></html>", f"<head><meta charset=utf-8><article>{rest}</article>", f"<body><form id=aspnetForm action=/><div class=top-menu>m</div><article>{rest}</article></form></body>",
        f"<body><form id=f><div class=c>{rest}</div><div class='nav'>x</div></form><div class=footer>f</div></body>", f"<body><article class='post related-work'>{rest}</article></body>", f"<body><div class='widget-content'><article>{rest}</article></div></body>",
        f"<body><article><div class='share-price'>{rest}</div></article><div class='share-buttons'>Share</div></body>", f"<body><article>{rest}</article><form><p>Your name</p><input></form></body>",
        f"<body><a b='\">x</a>{rest}</body>".replace("x</a>", "</a>"),
    ):
        assert text(page) == words, page[:120]
    a, b = "first part " * 25 + "end.", "second part " * 20 + "end."
    assert text(f"<body><div class=page><div class=a><p>{a}</p></div><div class=b><p>{b}</p></div></div></body>") == f"{a}\n\n{b}"
    assert text("<body><form><p>User</p><p>Password</p><button>Go</button></form></body>") in ("", "User\n\nPassword")
    assert text("<body><form>User <input> Password <input></form></body>") == ""
    assert text(f"<p>{words}<p>tail &amp; <br>more") == f"{words}\n\ntail & more"


@pytest.mark.parametrize("unit", ["<a ", '<a b="', "<a '", '<a ">" ', "<b>", "<div>", "<div class=x>", "</i>", "<b></i>", "<i><b>", "<!", "<!--", "<p><b>", "<hr><b>", "a", "<form><p>x", "<div class=sidebar>x", "&amp", "<script>", "<li>x", "<x y z", "<table><tr>"])
def test_html_takes_linear_time(unit):
    import time

    n = 60_000 // len(unit)
    for page in (unit * n, "<i><article>" + unit * n + ">", "<a " + unit * n + "<p>end", "<b>" * 5_000 + unit * n):
        start = time.perf_counter()
        assert isinstance(html_extract.main_text(page, None)[0], str)
        assert time.perf_counter() - start < 10, page[:30]


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline
    from ledgerloom.llm.cluster import stored

    line = lambda a: " ".join(f"{a}{k}" for k in range(50))
    rows = [(1, line("a")), (1, line("a")), (2, line("b")), (3, line("b")), (3, line("b")), (None, line("c")), (None, line("c")), (None, line("d")), (4, line("e")), (4, line("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.repeated_passages(spark, stored(corpus_pipeline.near_duplicates(spark, docs, ""), "rows"), "")
    want = [(1, line("a")), (2, line("b")), (None, line("c")), (None, line("d")), (4, line("e")), (4, line("f"))]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in left.collect()) == Counter((i, t, len(t)) for i, t in want)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    docs, labels = _labelled(spark)
    passage = " ".join(f"q{k}" for k in range(45))
    extra = [(600, "Plain words " + passage + " here."), (601, "Others that go " + passage + " there " + " ".join(f"z{k}" for k in range(60)) + "."), (602, "It says one two three four five six seven eight nine ten eleven twelve.")]
    from pyspark.sql import functions as F

    docs = docs.where("doc_id < 200").unionByName(_docs(spark, extra)).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(k % 2 == 0 for k in out if k < 200) and 602 not in out and 1 in out
    assert sentencepiece_codec.codec().decode(out[600].ids) == "Plain words here."


def test_html_hidden_names_comment_ends_and_depth():
    text = lambda page: html_extract.main_text(page, None)[0]
    body = "<article><p>First of the paragraphs here.</p>{}<p>Last of the paragraphs here.</p></article>"
    for tag in ('<p title="the hidden truth">Said.</p>', '<p class="x hidden md:block">Said.</p>', "<p data-x='a hidden' id=hidden-p>Said.</p>", "<p>Sa<!-->id.</p>", "<p>Said.<!--->", "<p>Said.<!-- > a --!></p>", "<!--!> x --><p>Said.</p>", "<p>Said.<!-- - -- > --></p>"):
        assert text(body.format(tag)).split("\n\n")[1:] == ["Said.", "Last of the paragraphs here."], tag
    for tag in ("<p hidden>Gone.</p>", "<p id=x HIDDEN>Gone.</p>", '<p hidden="until-found">Gone.</p>', '<div style="color:red; display : none">Gone.</div>', "<!-- a --!-- b -->"):
        assert "Gone" not in text(body.format(tag)) and text(body.format(tag)).count("paragraphs") == 2, tag
    deep = "<div class=a>" * 90 + "<div class=main><p>" + "The words of the text, in many words and more words, to the end of it. " * 4 + "</p></div><div class=other><p>Aside.</p></div>" + "</div>" * 90
    assert text(deep).count("end of it.") == 4 and "Aside" not in text(deep)
    assert "end" in text("<div>" * 5_000 + "the end")


def test_warc_overwrite_odd_headers_and_plain_records(spark, tmp_path):
    warc.register(spark)
    page = lambda *ids: warc.records(spark.createDataFrame([(i, "http://x/", f"<p>{i}</p>", b"mine") for i in ids], "page_id long, url string, html string, payload binary"))
    path = f"file://{tmp_path}/out"
    read = lambda p: sorted((r.record_id, r.record_type, bytes(r.payload) if r.payload is not None else None) for r in spark.read.format("warc").option("payload", "full").load(p).collect())
    page(1, 2).write.format("warc").mode("append").save(path)
    page(3).write.format("warc").mode("append").save(path)
    assert [r[2] for r in read(path)] == [b"<p>1</p>", b"<p>2</p>", b"<p>3</p>"]
    for _ in range(2):
        page(8, 9).write.format("warc").mode("overwrite").save(path)
    assert [r[2] for r in read(path)] == [b"<p>8</p>", b"<p>9</p>"]
    assert len(list((tmp_path / "out").glob("*.warc"))) <= 2

    def record(kind, block, extra=b""):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <" + kind + b">\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    other = tmp_path / "other"
    other.mkdir()
    http = "HTTP/1.1 200 OK\r\nServer: caf\u00e9\r\n\r\nbody".encode("latin-1")
    (other / "a.warc").write_bytes(record(b"response", http, "X-Odd: caf\u00e9\r\n".encode("latin-1")) + record(b"resource", b"a\r\n\r\nb") + record(b"conversion", b"text") + record(b"revisit", b"HTTP/1.1 200 OK\r\n\r\n"))
    assert read(f"file://{other}") == [("<conversion>", "conversion", b"text"), ("<resource>", "resource", b"a\r\n\r\nb"), ("<response>", "response", b"body"), ("<revisit>", "revisit", None)]


def test_lines_are_labelled_within_a_text(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choices(["the", "river", "ran", "over", "stones", "and", "under", "bridges", "towards", "evening"], k=12)).capitalize() + "."
    bad = lambda: " ".join(rnd.choices(["$$$", "##", "buy", "|", "***", "x1", "%%"], k=9))
    rows = [(k, "\n".join((good if k % 2 else bad)() for _ in range(6))) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    model = quality_crf.train(_docs(spark, rows), labels)
    mixed = "\n".join([good(), "", good(), good(), " \t", bad(), bad(), bad(), bad()])
    asked = [(1, mixed), (2, None), (3, ""), (None, "one line"), (1, mixed)]
    got = quality_crf.line_labels(spark.createDataFrame(asked, "doc_id long, text string").selectExpr("*", "'mine' as line", "1 as good"), model).collect()
    mine = [r for r in got if r.doc_id == 1]
    assert len(mine) == 14 and all(0 <= r.marginal <= 1 and r.good == (r.marginal >= 0.5) for r in mine)
    assert {r.line: r.good for r in mine} == {0: True, 2: True, 3: True, 5: False, 6: False, 7: False, 8: False} and all(r.text == mixed.split("\n")[r.line] for r in mine)
    assert [(r.line, r.text) for r in got if r.doc_id is None] == [(0, "one line")] and not [r for r in got if r.doc_id in (2, 3)]
