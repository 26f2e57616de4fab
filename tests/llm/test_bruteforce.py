"""Methods against plain versions: joins of hot keys, mixtures, sketches, rules, the stages, and the registered queries."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.llm import common, jaccard_join, language_id, queries, rule_quality, sketches, stages, warc
from driftgauge.llm.common import spread_join, table

SF = "/root/testdata/sf0.001"


def crc_fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


def test_spread_join_equals_join_and_spreads(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = [("hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 20_000}", i) for i in range(90_000)]
        left = spark.createDataFrame(data, "key string, i long").repartition(4)
        right = left.where("key IS NOT NULL").groupBy("key").agg(F.max("i").alias("top"), F.count("*").alias("n"))
        joined = spread_join(left, right, "key", "n", len(data), ["i"])
        got = {r.i: (r.key, r.top) for r in joined.select("i", "key", "found.top").collect()}
        top = collections.defaultdict(int)
        for k, i in data:
            top[k] = max(top[k], i)
        assert got == {i: (k, None if k is None else top[k]) for k, i in data}
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert any("hashpartitioning(key" in x and "_salt" in x for x in plan.split("\n"))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1.2 * len(data) / 4
        kept = spread_join(left, right, "key", "n", len(data), ["i"], drop=("i", lambda found: found["top"] > 5)).where("key = 'hot' AND i IS NOT NULL").count()
        assert kept == 0
        assert spread_join(left.limit(0), right, "key", "n", 0, ["i"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_folder_is_named_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_discarded_tables_are_gone(spark, tmp_path):
    from pathlib import Path

    t = common.materialise(spark.range(3), "gone")
    path = Path(t._scratch.removeprefix("file:"))
    assert path.exists() and t.count() == 3
    common.discard(t)
    assert not path.exists()


# Language


def plain_slots(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not any(c.isalpha() for c in text):
        return None
    line, out = "  " + " ".join(words) + "  ", collections.Counter()
    for a, b, c in zip(line, line[1:], line[2:]):
        h = (ord(a) * 0x9E3779B1 & 0xFFFFFFFF) ^ (ord(b) * 0x85EBCA77 & 0xFFFFFFFF) ^ (ord(c) * 0xC2B2AE3D & 0xFFFFFFFF)
        h ^= h >> 15
        out[(h * 0x27D4EB2F & 0xFFFFFFFF) >> 17] += 1
    return out


def plain_mixture(counts, p, prior, own):
    weight = sum(prior[k] for k in own)
    base = {k: prior[k] / weight for k in own}
    share = dict(base)
    for _ in range(1000 if len(own) > 1 else 0):
        new = dict(base)
        for slot, n in counts.items():
            whole = sum(p[k][slot] * share[k] for k in own)
            for k in own:
                new[k] += n * p[k][slot] * share[k] / whole
        whole = sum(new.values())
        new = {k: v / whole for k, v in new.items()}
        moved = max(abs(new[k] - share[k]) for k in own)
        share = new
        if moved <= 1e-4:
            break
    return share, sum(n * math.log(sum(p[k][slot] * share[k] for k in own)) for slot, n in counts.items())


def plain_language(counts, p, prior):
    names = sorted(prior)
    alone = {k: sum(n * math.log(p[k][slot]) for slot, n in counts.items()) for k in names}
    best = max(names, key=lambda k: (alone[k], [-ord(c) for c in k]))
    whole = plain_mixture(counts, p, prior, names)[0]
    order = [best, *sorted((k for k in names if k != best), key=lambda k: -whole[k])]
    chosen, reached = None, -math.inf
    for k in range(1, len(order) + 1):
        share, like = plain_mixture(counts, p, prior, sorted(order[:k]))
        value = like - 4.0 * math.log(sum(counts.values()) + 1) * (k - 1)
        if value <= reached:
            break
        chosen, reached = share, value
    top = max(sorted(chosen), key=lambda k: chosen[k])
    return top, chosen[top]


def test_op2_equals_plain_mixture(spark, rows):
    """The query against an EM in plain loops, learned from the same rows (all, as none is left out of so small a sample)."""
    got = {r.doc_id: r for r in queries.QUERIES["op2_language_id"](spark, SF).collect()}
    assert len(got) == len(rows)
    counts, totals = {}, collections.Counter()
    for i, r in rows.items():
        if crc_fold(i, 3) != 1 and r.lang is not None and r.text is not None:
            totals[r.lang] += 1
            counts.setdefault(r.lang, collections.Counter()).update(plain_slots(r.text) or {})
    assert max(totals.values()) <= language_id.PER_LANGUAGE
    p = {}
    for k, c in counts.items():
        whole = sum(c.values()) + 0.5 * language_id.SLOTS
        p[k] = collections.defaultdict(lambda whole=whole: 0.5 / whole, {s: (n + 0.5) / whole for s, n in c.items()})
    prior = {k: n / sum(totals.values()) for k, n in totals.items()}
    right = asked = 0
    for i, r in rows.items():
        assert got[i].held_out == (crc_fold(i, 3) == 1)
        c = plain_slots(r.text or "")
        if c is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        name, share = plain_language(c, p, prior)
        assert got[i].lang_pred == name and abs(got[i].score - share) < 1e-3, i
        if got[i].held_out and r.lang and len(r.text) > 50:
            asked, right = asked + 1, right + (name == r.lang)
    assert asked > 20 and right / asked > 0.95


@pytest.mark.parametrize(("text", "letter"), [("x²", True), ("H₂O", True), ("m² cm²", True), ("②a", True), ("²", False), ("12 ½ ²", False), ("_", False), ("ª", True), ("٣", False), ("字", True), ("", False)])
def test_texts_with_a_letter_have_a_language(text, letter):
    assert (language_id.slots(text) is not None) == letter == any(c.isalpha() for c in text)


def test_language_sample_is_bounded_without_ids(spark):
    many = spark.createDataFrame([(None, f"wort nummer {'abcdefghij'[i % 10] * (i % 97 + 1)}", "de") for i in range(5000)] + [(None, "same text", "en")] * 5000, "doc_id long, text string, lang string")
    seen = []
    real = language_id._count

    def spy(batches):
        return real(batches)

    model = language_id.train(many, per_language=100)
    assert model.languages == ["de", "en"]
    p = model.p[:, 1] * 0
    assert len(p) == language_id.SLOTS and not seen and spy
    # "same text" is learned from once or not at all
    ratio = model.p[:, 1].max() / model.p[:, 1].min()
    assert ratio <= 5


# Sketches


def order_of(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))


@pytest.mark.parametrize(("kind", "size", "fine"), [("ids", 200, 3), ("ids", 1, 1), ("one id", 150, 4), ("no ids", 150, 4), ("mixed", 100, 2), ("mixed", 1 << 24, 2000)])
def test_next_rows_whatever_the_ids(spark, kind, size, fine):
    rng = np.random.default_rng(3)
    texts = [f"t{rng.integers(0, 60)} " + "x" * int(rng.integers(0, 30)) for _ in range(80)]
    ids = {"ids": range(80), "one id": [7] * 80, "no ids": [None] * 80, "mixed": [None if i % 4 == 0 else 7 if i % 4 == 1 else i - 40 for i in range(80)]}[kind]
    df = spark.createDataFrame(list(zip(ids, texts)), "id long, text string").repartition(3)
    hashed = [(r.id, r.text, r.h) for r in df.select("id", "text", F.xxhash64("text").alias("h")).collect()]
    got = sketches.with_next(df, {}, size, fine).collect()
    ordered = order_of(hashed)
    want = collections.Counter((i, t, n[1]) for (i, t, _), n in zip(ordered, [*ordered[1:], ordered[0]]))
    assert collections.Counter((r.id, r.text, r.next_text) for r in got) == want
    if size < 1000:
        starts = sketches.ranges(df, size, fine)
        assert len(starts) > 4 and starts == sorted(set(starts))


def test_ranges_are_tasks_of_their_own(spark):
    df = spark.range(4000).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sketches.with_next(df, {}, 20_000, 20)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "shufflepartitionidpassthrough" in plan
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 20 and max(sizes) <= 260
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_estimates_above_k(spark):
    """Resemblance and containment of long texts are within five standard deviations of the exact values."""
    words = [f"w{i}" for i in range(6000)]
    pairs = [(words[:4000], words[1000:5000]), (words[:4000], words[:2000]), (words[:3000], words[3000:]), (words, words)]
    df = spark.createDataFrame([(k, " ".join(a), " ".join(b)) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    df = df.select("k", sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    got = {r.k: r for r in df.select("k", sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.containment(F.col("a"), F.col("b")).alias("c")).collect()}
    for k, (a, b) in enumerate(pairs):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        like, held = len(x & y) / len(x | y), len(x & y) / len(x)
        assert abs(got[k].r - like) <= 5 * math.sqrt(like * (1 - like) / sketches.K) + 1e-9
        assert abs(got[k].c - held) <= 0.35 and (held > 0 or got[k].c == 0)


def test_op4_query(spark, rows):
    got = {r.doc_id: r for r in queries.QUERIES["op4_fingerprints"](spark, SF).collect()}
    order = sorted(rows, reverse=True)
    assert sorted(got) == sorted(rows)
    for i, after in zip(order, [*order[1:], order[0]]):
        t, nxt = rows[i].text or "", rows[after].text or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = collections.defaultdict(set)
    for i, r in got.items():
        by[rows[i].text or ""].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())


# WARC


def test_hot_payloads_are_dealt(spark):
    """Of a payload that half of all pages share, only the response's body goes through the exchange."""
    body = "<html>" + "x" * 2000
    data = [(i, f"u{i}", body if i % 2 else f"{body}{i}") for i in range(2000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)
    got = warc.plan_records(pages).collect()
    assert sum(r.payload is not None for r in got) == 1001 and len(got) == 2000
    assert {r.refers_to for r in got} == {None, 1999}
    assert next(r for r in got if r.page_id == 1999).payload == body.encode()


# Quality


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x != ""]
    n, chars = len(words), len(text)
    bare = [c for c in text if __import__("unicodedata").category(c).startswith("L")]
    upper = sum(__import__("unicodedata").category(c) == "Lu" for c in bare)

    def share(a, b):
        return a / b if b else 0.0

    def of(signs):
        return share(sum(c in signs for c in text), chars)

    return [math.log1p(chars), math.log1p(n), share(chars, n), share(len(set(words)), n), share(sum(a == b for a, b in zip(words, words[1:])), n) if n > 1 else 0.0, share(len(bare), chars), share(upper, len(bare)), of("0123456789"), of("#*$%&<>"), of("|"), of("!?"), share(text.count("."), n), share(n, len(lines)), share(len(set(lines)), len(lines))]


def test_op6_equals_plain_rules(spark, rows):
    """The compiled column against rules read one by one over plain statistics of every text; held-out accuracy."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    model = rule_quality.train(docs, labels.where(F.expr("crc32(cast(doc_id as string)) % 4 <> 2")))
    got = {r.doc_id: r for r in queries.QUERIES["op6_quality"](spark, SF).collect()}
    assert sorted(got) == sorted(rows) and model.rules
    x = np.array([plain_statistics(rows[i].text or "") for i in sorted(rows)])
    learned = np.array([[*plain_statistics(rows[i].text or ""), q] for i, q in marks.items() if q in (0, 1) and i in rows and crc_fold(i, 4) != 2])
    learned = learned[np.lexsort((*learned[:, :-1].T, learned[:, -1]))]
    again = rule_quality.fit(learned[:, :-1], learned[:, -1])
    right = asked = 0
    for i, stats in zip(sorted(rows), x):
        total = again.intercept
        for rule, weight in again.rules:
            if all(stats[j] > at if above else stats[j] <= at for j, above, at in rule):
                total += weight
        score = 1 / (1 + math.exp(-total))
        r = got[i]
        assert abs(r.score - score) < 1e-6, i
        assert r.predicted == int(r.score >= 0.7) and r.held_out == (crc_fold(i, 4) == 2)
        if r.held_out and marks.get(i) in (0, 1):
            asked, right = asked + 1, right + (r.predicted == marks[i])
    assert asked and right / asked > 0.9


def test_quality_sample_is_bounded(spark):
    """An id counts once for each label, however often both tables repeat it."""
    docs = spark.createDataFrame([(1, "good words here to read")] * 50 + [(i, f"text {i} # # #") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 500 + [(i, 0) for i in range(2, 40)], "doc_id long, quality int")
    model = rule_quality.train(docs, labels)
    alone = rule_quality.train(docs.distinct(), labels.distinct())
    assert model == alone


# Join


def test_the_heap_is_used_on_blocks_of_short_texts(monkeypatch):
    """Heap-merged and counted lists give the same links; the heap is taken where a set's short lists are few."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 62, int(rng.integers(3, 400))).astype(np.uint64))
        sets += [base, base[1:] if len(base) > 2 else base, np.unique(np.append(base, rng.integers(0, 1 << 62, 1).astype(np.uint64)))]
    calls = []
    real = jaccard_join.heapq.merge
    monkeypatch.setattr(jaccard_join.heapq, "merge", lambda *a: calls.append(len(a)) or real(*a))

    def pairs(heap):
        monkeypatch.setattr(jaccard_join, "HEAP", heap)
        calls.clear()
        return sorted((q, r) for q, found in jaccard_join.search(sets, None, 80) for r in found.tolist())

    counted = pairs(-1)
    assert not calls
    assert pairs(64) == counted and calls
    assert pairs(1 << 30) == counted and len(calls) > 60
    plain = [(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert sorted({tuple(sorted(x)) for x in plain}) == sorted({tuple(sorted(x)) for x in counted})


def test_large_blocks_meet_by_size(spark, monkeypatch):
    """Every pair of sets whose sizes can link shares exactly one tile; others share none or one."""
    monkeypatch.setattr(jaccard_join, "TILE", 300)
    rng = np.random.default_rng(4)
    data = [(bytes([i % 256, i // 256]), int(n), 0 if i < 400 else i) for i, n in enumerate(rng.integers(3, 200, 420))]
    active = spark.createDataFrame(data, "digest binary, n long, block long")
    got = jaccard_join.with_tiles(active, 80).collect()
    assert len(got) == len(data)
    rows = [r for r in got if r.block == 0]
    tiles = {}
    for r in rows:
        assert all(r.chunk in (t.i, t.j) for t in r.tiles) and len(set(r.tiles)) == len(r.tiles)
        tiles[bytes(r.digest)] = {(t.i, t.j) for t in r.tiles}
    every = [(x, y) for k, x in enumerate(rows) for y in rows[:k]]
    met = 0
    for x, y in every:
        pair = (min(x.chunk, y.chunk), max(x.chunk, y.chunk))
        shared = pair in tiles[bytes(x.digest)] and pair in tiles[bytes(y.digest)]
        met += shared
        if 100 * min(x.n, y.n) >= 80 * max(x.n, y.n):
            assert shared
    assert met < 0.6 * len(every)
    assert all([(t.i, t.j) for t in r.tiles] == [(0, 0)] for r in got if r.block)


# Stages


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_stages_equal_plain_versions(spark, rows, tmp_path):
    """Each stage's kept ids against a plain version on its own input."""
    docs = table(spark, SF, "documents")
    kept = written(stages.language_stage(spark, docs, SF), tmp_path / "a")
    model = language_id.train(docs)
    want = {i for i, r in rows.items() if (x := model.infer(r.text or ""))[0] != "und" and x[1] >= stages.LEAST_SHARE}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == want and kept.columns == docs.columns

    after = written(stages.quality_stage(spark, kept, SF), tmp_path / "b")
    rules = rule_quality.train(kept, table(spark, SF, "labels"))
    scores = rules.score(np.array([plain_statistics(rows[i].text or "") for i in sorted(ids)]))
    want = {i for i, s in zip(sorted(ids), scores) if s >= rule_quality.THRESHOLD}
    ids = {r.doc_id for r in after.select("doc_id").collect()}
    assert ids == want

    last = written(stages.near_duplicate_stage(spark, after.repartition(5), SF), tmp_path / "c")
    sets, root = {}, {}
    for i in sorted(ids):
        w = (rows[i].text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(ids):
        for b in sorted(ids):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i for i in ids if find(i) == i}
    assert {r.doc_id for r in last.select("doc_id").collect()} == want and last.columns == docs.columns

    packed = stages.packing_stage(spark, last, SF).collect()
    assert {r.doc_id for r in packed} == want
    loads = collections.Counter()
    for r in packed:
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 2048


def test_near_duplicates_of_a_frame_that_is_dealt_anew(spark):
    """Rows keep their place although the frame is shuffled and read twice; rows without id are told apart."""
    text = "one two three four five six seven eight nine ten"
    data = [(None, text)] * 3 + [(i, f"row {i} " + f"p{i} " * (i + 5)) for i in range(20)] + [(5, text)] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("x", F.rand()).orderBy("x")
    kept = stages.near_duplicate_stage(spark, docs, "").collect()
    assert [r.doc_id for r in kept if r.text == text] == [5]


# Registered queries


CONTRACT = {
    "op1_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_repetition": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op9_licences": ["doc_id"],
    "op10_jaccard": ["doc_id", "n_shingles", "component_id"],
}


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_of_the_queries(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(CONTRACT[name]) <= set(got.columns)
    key = "page_id" if name == "op5_warc" else "doc_id"
    want = table(spark, SF, "pages" if name == "op5_warc" else "documents").count()
    assert got.select(key).distinct().count() == want


def test_op1_query(spark, rows):
    from driftgauge.llm import token_counts, vocab

    library = vocab.byte_bpe(token_counts.JSON, token_counts.RANKS).library
    for r in queries.QUERIES["op1_token_counts"](spark, SF).collect():
        t = rows[r.doc_id].text or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)


def test_op8_query(spark, rows):
    from driftgauge.llm import packing, token_counts, vocab

    library = vocab.byte_bpe(token_counts.JSON, token_counts.RANKS).library
    got = {(r.doc_id, r.piece): r for r in queries.QUERIES["op8_packing"](spark, SF).collect()}
    n, sizes = 0, collections.Counter()
    for i, r in rows.items():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, length) in enumerate(packing.cut(len(ids), 2048)):
            n, sizes[length] = n + 1, sizes[length] + 1
            x = got[i, k]
            assert (x.start, x.length, x.ids_crc32) == (s, length, zlib.crc32(ids[s : s + length].tobytes()))
    assert n == len(got)
    used = len({x.sequence_id for x in got.values()})
    gaps = []
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            fit = min((g for g in gaps if g >= size), default=2048)
            if fit in gaps:
                gaps.remove(fit)
            gaps.append(fit - size)
    assert used <= len(gaps)
