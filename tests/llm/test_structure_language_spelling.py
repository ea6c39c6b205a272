"""Conversation repair, language identification and spelling variants against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversations, language_id, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


# ---- conversations ----------------------------------------------------------------------------------------------


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _best(rows, faults):
    """All whole strings of edits for each last role (no tree, no pruning): the cheapest, then the least string."""
    ways = {"": [(0, "", ())]}  # last role kept: every cheapest way, with its whole string

    def inserts(ways):
        out = {k: list(v) for k, v in ways.items()}
        for _ in range(2):
            for last, found in list(out.items()):
                for cost, audit, kept in list(found):
                    new = NEXT[last]
                    out.setdefault(new, []).append((cost + 5, audit + "I", (*kept, ("user" if new == "u" else "assistant") + ":")))
        return {k: sorted(set(v))[:40] for k, v in out.items()}

    for (_, role, text), fault in zip(rows, faults, strict=True):
        now = defaultdict(list)
        for last, found in inserts(ways).items():
            for cost, audit, kept in found:
                now[last].append((cost + 2, audit + "D", kept))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault == "truncated" else 0
                if role[:1] == NEXT[last] or (role[:1] == "s" and last == ""):
                    now[role[:1]].append((cost + more, audit + "K", (*kept, f"{role}:{text}")))
                now[NEXT[last]].append((cost + more + 1, audit + "R", (*kept, ("user" if NEXT[last] == "u" else "assistant") + ":" + text)))
        ways = {k: sorted(v)[:40] for k, v in now.items()}
    return min(itertools.chain(*(inserts(ways).get(k, []) for k in ("", "a"))))


def _expected(conv):
    rows = sorted(conv, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]))
    faults = _faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, kept = _best(rows, faults)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def _damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
        yield from [(conv, turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)


def _conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.choice([1, 2, 3, 5, 8, 14])):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "User", "", None])
            text = rnd.choice(["Yes.", "No!", "what", "", " \n", None, "a. b", "ok?\t ", "é…"]) if rnd.random() < 0.6 else f"t{rnd.random()}."
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn, None, turn // 2, 3 * turn]), role, text))
    return rows


def test_repair_equals_brute_force(spark, tmp_path):
    rows = _conversations(5, 150)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit("x")).withColumn("step", F.lit(1))
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r)[1:] for r in conversations.op11_conversation_repair(spark, str(tmp_path)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    by = defaultdict(list)
    for conv, *row in _damage(rows):
        by[conv].append(tuple(row))
    assert got.keys() == {r[0] for r in rows}
    for conv, found in got.items():
        assert found == (_expected(by[conv]) if conv in by else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())), (conv, by.get(conv))


def test_repair_of_odd_tables(spark):
    kind = "conv_id string, turn int, role string, text string"
    assert conversations.repair(spark.createDataFrame([], kind)).count() == 0
    got = conversations.repair(spark.createDataFrame([("x", 1, "user", "Hello." * 50_000), ("x", 2, "user", "Again?"), (None, None, None, None)], kind)).orderBy("conv_id", "step").collect()
    assert [(r.conv_id, r.edit, r.cost, r.role) for r in got] == [(None, "D", 2, None), ("x", "K", 0, "user"), ("x", "R", 1, "assistant")]


def test_survivors_hold_little_and_decide_long_ties():
    rnd = random.Random(1)
    one = conversations.Survivors()
    most, out = 0, []
    for k in range(4000):  # a well-formed conversation with some faults
        role = "ua"[k % 2] if rnd.random() < 0.9 else rnd.choice("uast")
        out += one.row((k, role, f"{k}.", None), role, rnd.choice([None] * 8 + ["blank", "truncated"]))
        most = max(most, one.held)
    out += one.end()
    assert most < 60 and sum(e != "I" for e, _, _ in out) == 4000
    for start in ("", "u"):  # rows of another role leave two ways that are tied over all rows
        roles = start + "t" * 400
        one = conversations.Survivors()
        found = "".join(e for k, r in enumerate(roles) for e, _, _ in one.row((k, r, "x.", None), r, None)) + "".join(e for e, _, _ in one.end())
        assert found == _best([(k, r, f"{k}.") for k, r in enumerate(roles)], [None] * len(roles))[1]


# ---- languages --------------------------------------------------------------------------------------------------


def _texts(n=120, seed=2):
    rnd = random.Random(seed)
    parts = {"xx": ["ba", "bo", "lu"], "yy": ["ké", "zì", "ßt"], "zz": ["мо", "ла", "na"]}
    rows = []
    for k in range(n):
        lang = list(parts)[k % 3]
        rows.append((k, " ".join("".join(rnd.choices(parts[lang], k=rnd.randrange(1, 5))) for _ in range(rnd.randrange(1, 30))), lang))
    return rows


def _brute_probabilities(texts):
    """Interpolated Kneser-Ney by its definition, over strings."""
    n = language_id.ORDER
    counts = [Counter() for _ in range(n + 1)]
    for t in texts:
        s = "\0" * (n - 2) + re.sub(r"[\W\d_]+", " ", f" {t.lower()} ")
        counts[n].update(s[k : k + n] for k in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (1 << language_id.BITS)
        c = counts[k]
        a, b = (sum(v == x for v in c.values()) for x in (1, 2))
        d = a / (a + 2 * b) if a else 0.5
        after = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(c[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

    return p


def test_models_equal_the_definition(spark):
    rows = [r for r in _texts() if r[2] != "zz"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame)
    apart = {r[0] for r in frame.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(16)) == 0).collect()}
    assert model["langs"] == ["xx", "yy"] and apart
    for lang, m in zip(model["langs"], model["models"], strict=True):
        p = _brute_probabilities([t for k, t, x in rows if x == lang and k not in apart])
        for gram in (" balu", "\0\0\0 b", "kézìß", "zìßt ", "qqqqq", "lubaq", "oluké"):
            key = np.array([sum(ord(c) << language_id.BITS * (4 - k) for k, c in enumerate(gram))], np.int64)
            assert m.probability(key)[0] == pytest.approx(p(gram), rel=1e-9), gram


def test_languages_are_told_apart(spark):
    rows = _texts(240)
    taught = spark.createDataFrame([r for r in rows if r[0] % 4], "doc_id long, text string, lang string").unionByName(spark.createDataFrame([(None, None, "xx"), (9, "words", None), (None, "balu", "xx"), (5, "", "yy")], "doc_id long, text string, lang string"))
    model = language_id.train(taught)
    asked = [(k, t) for k, t, _ in rows if k % 4 == 0] + [(1000, None), (1001, ""), (1002, " 12 -- "), (None, "balubo balu"), (1003, "ké " * 400_000), (1003, "ké"), (1004, "𝒜𝒷" * 3)]
    frame = spark.createDataFrame(asked, "doc_id long, text string").withColumn("lang_pred", F.lit("q")).withColumn("score", F.lit(7)).repartition(3)
    got = language_id.identify(frame, model).collect()
    assert len(got) == len(asked) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[k] for k, _, _ in rows if k % 4 == 0] == [x for k, _, x in rows if k % 4 == 0]
    assert by[1000] == by[1001] == by[1002] == "und" and by[None] == "xx" and by[1003] == "yy" and by[1004] in model["langs"]
    assert {r.doc_id: r.lang_pred for r in language_id.identify(frame, model, reject=1.1).collect()}[0] == "und"
    nothing = language_id.train(frame.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in language_id.identify(frame, nothing).collect()} == {"und"}
    assert language_id.identify(frame.limit(0), model).count() == 0


def test_a_bound_on_keys_keeps_the_most_frequent(spark):
    rows = _texts(200)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame, share=30)
    assert all(len(k) <= 30 for m in model["models"] for k in (*m.keys, *m.history))
    got = language_id.identify(frame, model).join(frame.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)


def test_a_bound_on_keys_changes_no_result(spark, monkeypatch):
    """Keys that aren't broadcast are joined with the model's tables: entropies are those of the definition, whatever the bound."""
    rows = _texts(120)
    taught = spark.createDataFrame([r for r in rows if r[0] % 4], "doc_id long, text string, lang string")
    apart = {r[0] for r in taught.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(16)) == 0).collect()}
    ps = [_brute_probabilities([t for k, t, x in rows if x == lang and k % 4 and k not in apart]) for lang in ("xx", "yy", "zz")]
    asked = [(k, t) for k, t, _ in rows if k % 3 == 0][:12] + [(7, "qqq бр lu"), (7, "qqq бр lu"), (None, "мо ké"), (8, "11"), (9, None)]
    frame = spark.createDataFrame(asked, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(language_id, "ROW_KEYS", 3)

    def told(share):
        model = language_id.train(taught, share=share)
        return model["slope"], sorted((r.doc_id or 0, r.lang_pred, r.score, r.entropy) for r in language_id.identify(frame, model).collect() if r.entropy is not None)

    whole = told(None)
    for share in (1, 100):
        slope, got = told(share)
        assert slope == pytest.approx(whole[0], rel=1e-6)
        assert [g[:2] for g in got] == [w[:2] for w in whole[1]]
        assert [x for g in got for x in g[2:]] == pytest.approx([x for w in whole[1] for x in w[2:]], rel=1e-6)
    n = language_id.ORDER
    best = []
    for k, t in asked[:-2]:
        s = "\0" * (n - 2) + re.sub(r"[\W\d_]+", " ", f" {t.lower()} ")
        grams = [s[i : i + n] for i in range(len(s) - n + 1)]
        best.append((k or 0, min(sum(-math.log(p(g)) for g in grams) / len(grams) for p in ps)))
    assert [x for _, x in sorted(best)] == pytest.approx([g[3] for g in sorted(whole[1], key=lambda g: (g[0], g[3]))], rel=1e-9)


def test_blocks_of_long_texts_give_the_same_counts(monkeypatch):
    text = "Ünd dann, ba lu 12 " * 40
    whole = language_id.counted(text)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, language_id.counted(text), strict=True))


# ---- spelling ---------------------------------------------------------------------------------------------------


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _grouped(words):
    near = {w: [v for v in words if _near(w, v)] for w in words}
    form = {w: f if (f := min(near[w], key=lambda v: (-words[v], v), default=None)) and words[f] >= 5 * words[w] else None for w in words}
    root = {}
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {(w, form[w], root[w], words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def test_variants_equal_brute_force(spark):
    rnd = random.Random(4)
    words = {}
    for _ in range(60):
        base = "".join(rnd.choices("aabé", k=rnd.randrange(1, 8)))
        words[base] = rnd.choice([5, 25, 125, 700])
        for _ in range(6):
            k = rnd.randrange(len(base) + 1)
            words[rnd.choice([base[:k] + rnd.choice("abé") + base[k:], base[:k] + base[k + 1 :], base[:k] + rnd.choice("abÿ") + base[k + 1 :]])] = rnd.choice([1, 1, 5, 5, 25, 3500])
    words.pop("", None)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in variants.variants(frame).collect()} == _grouped(words)
    assert variants.variants(frame.limit(0)).count() == 0
    assert max(len(r[4:]) for r in _grouped(words)) and any(r[2] not in (r[0], r[1]) for r in _grouped(words))  # chains of forms


def test_spelling_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    vocabulary = ["Straßen", "straßen", "straßem", "wonderful", "wonderfull", "Wonderful", "short", "ÀÉÎõüÿ", "àÉÎõüÿ", "sixsix"] + ["w" + "".join(rnd.choices("xyz", k=7)) for _ in range(30)]
    rows = [(k if k else None, "-".join(rnd.choices(vocabulary, weights=[9] * 10 + [1] * 30, k=rnd.randrange(0, 60)))) for k in range(300)] + [(7, None), (8, ""), (8, "sixsix " * 70_000), (8, "12 _ 3")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'q' as word", "2 as prefix").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'' if k is None else k}:{low}".encode())
            counts[low if h % 199 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = {tuple(r) for r in variants.op13_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == _grouped(words) and any(r[1] for r in got)
