"""Operators on a small, messy table: nulls, empty and long texts, repeats, clashing columns; each against a plain version."""

import hashlib
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.llm import jaccard_join, language_id, licences, packing, repetition, rule_quality, segment_bpe, sketches, stages, token_counts, vocab, warc
from driftgauge.llm.common import scratch

EN = "the quick brown fox jumps over the lazy dog and then walks home with the other animals of the wide forest"
DE = "der schnelle braune fuchs springt über den faulen hund und geht dann mit den anderen tieren nach hause im wald"
TEXTS = [
    (1, EN, "en"),
    (2, EN, "en"),
    (3, EN + " again", "en"),
    (4, DE, "de"),
    (5, None, "en"),
    (6, "", None),
    (7, "  \n\t ", "de"),
    (8, "123 456 !!", "en"),
    (9, "kurz", "de"),
    (10, "wörter <|endoftext|> don't <|startoftext|> ΑΣ x\x1cy  z \n", "en"),
    (11, "long " * 30000, "en"),
    (12, "abc def ghi\nabc def ghi\n" + "one two three four five six seven " * 4, "en"),
    (12, "abc def ghi\nabc def ghi\n" + "one two three four five six seven " * 4, "en"),
    (None, EN + " null id", "en"),
    (13, "The Quick " + EN[10:].upper(), "en"),
]
CLASH = ["n_tokens", "_text", "_id", "id", "digest", "score", "row", "key", "place", "_stats", "sketch", "length", "_score", "found"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, lang, "src0", len(t) if t else 0) for i, t, lang in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3).select("*", *[F.lit("x").alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts_by_id():
    return {i: t or "" for i, t, _ in TEXTS}


def test_token_counts(spark, docs, none):
    cache = scratch(spark, "cache")
    got = token_counts.token_counts(docs, cache).collect()
    bpe = vocab.byte_bpe(token_counts.JSON, token_counts.RANKS)
    want = {i: len(bpe.library.encode(t, add_special_tokens=False).ids) for i, t in texts_by_id().items()}
    assert len(got) == len(TEXTS) and all(r.n_tokens == want[r.doc_id] and r.n_bytes == len(texts_by_id()[r.doc_id].encode()) for r in got)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    size = spark.read.parquet(cache).count()
    assert size == len(set(texts_by_id().values()))
    again = token_counts.token_counts(docs, cache).collect()  # all hits: nothing is encoded or appended
    assert sorted(map(str, again)) == sorted(map(str, got)) and spark.read.parquet(cache).count() == size
    assert token_counts.token_counts(none, scratch(spark, "cache")).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a  b \n c", "a \n", "\n a", "foo<|endoftext|> bar", "日本語 テスト ١٢٣", "é ½ ² a_b", "\x1c a \x85 b\xa0c", "don't  we'll 's", " lead", "trail ", "a\t b", "x" * 5000])
def test_byte_bpe_equals_library(text):
    bpe = vocab.byte_bpe(token_counts.JSON, token_counts.RANKS)
    assert np.frombuffer(bpe.packed(text), "<u4").tolist() == bpe.library.encode(text, add_special_tokens=False).ids


def test_word_bpe_equals_library(spark, docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab.path(segment_bpe.JSON))
    for r in segment_bpe.bpe_digests(docs).collect():
        ids = library.encode(texts_by_id()[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert segment_bpe.bpe_digests(none).count() == 0
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(segment_bpe.encode_ids()("text").alias("ids")).select("ids", segment_bpe.decode_ids()("ids").alias("t")).collect()
    assert all(r.t == library.decode(r.ids, skip_special_tokens=False) for r in rows)


def test_segment_tree_merges_leftmost_lowest():
    pairs = {(0, 0): (1, 2), (2, 0): (0, 3), (2, 2): (5, 4)}

    def plain(s):
        s = list(s)
        while True:
            found = [(pairs[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in pairs]
            if not found:
                return s
            _, i = min(found)
            s[i : i + 2] = [pairs[s[i], s[i + 1]][1]]

    rng = np.random.default_rng(0)
    for n in range(1, 40):
        s = rng.integers(0, 2, n).tolist()
        assert segment_bpe.merge_word(list(s), pairs) == plain(s)


def test_language(spark, docs, none):
    model = language_id.train(docs.where("doc_id NOT IN (9, 11)"))
    got = {r.doc_id: r.r for r in docs.select("doc_id", language_id.language(docs, model).alias("r")).collect()}
    assert got[1].lang_pred == "en" and got[4].lang_pred == "de"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (5, 6, 7, 8))
    assert all(0 <= r.score <= 1 for r in got.values())
    many = spark.createDataFrame([(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    mixed = language_id.train(many).infer(" ".join([EN] * 3 + [DE] * 3))
    assert sorted(mixed[2]) == ["de", "en"] and 0.3 < mixed[1] < 0.7
    empty = language_id.train(none)
    assert empty.infer(EN)[0] == "und"


def test_repetition(docs, none):
    got = {r.doc_id: r for r in repetition.repetition(docs).collect()}
    for i, text in texts_by_id().items():
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        inside = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        seen, twice = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                twice += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(inside), twice)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words)) and not (r.base_failed and r.kept)
    assert got[1].kept and not got[11].kept
    assert repetition.repetition(none).count() == 0


def test_sketches(spark, docs, none):
    got = sketches.fingerprints(docs).collect()
    assert len(got) == len(TEXTS)
    order = sorted([(i is None, -(i or 0), t or "") for i, t, _ in TEXTS])
    texts = [t for *_, t in order]
    ids = [None if n else -i for n, i, _ in order]

    def shingles(t):
        w = t.encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def like(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0

    want = {}
    for k, (i, t) in enumerate(zip(ids, texts)):
        nxt, cut = texts[(k + 1) % len(texts)], len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), like(shingles(t), shingles(edited)), like(shingles(t), shingles(nxt))))
    for r in got:
        assert any(w[:2] == (r.n_chars, r.edited_sha256) and abs(w[2] - r.near_edited) < 1e-9 and abs(w[3] - r.near_next) < 1e-9 for w in want[r.doc_id]), r.doc_id
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[1] == same[2] != same[4]
    assert sketches.fingerprints(none).count() == 0


def test_sketch_merge_and_estimates(spark):
    words = [f"w{i}" for i in range(3000)]
    parts = spark.createDataFrame([(1, " ".join(words[:2000])), (1, " ".join(words[1996:])), (2, " ".join(words))], "k int, text string")
    rows = parts.select("k", sketches.sketch(F.col("text")).alias("sketch"))
    merged = {r.k: r.sketch for r in sketches.merge_sketches(rows, ["k"]).collect()}
    assert merged[1] == merged[2] and len(merged[1]) == sketches.K
    n = rows.where("k = 2").select(sketches.distinct_shingles(F.col("sketch")).alias("n")).first().n
    assert abs(n / 2996 - 1) < 0.3


def test_rules(spark, docs, none):
    rng = np.random.default_rng(1)
    x = rng.random((1500, len(rule_quality.NAMES)))
    y = ((x[:, 8] < 0.5) & (x[:, 3] > 0.2)).astype(float)
    model = rule_quality.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 200
    cols = spark.createDataFrame([(v.tolist(),) for v in x[:50]], "s array<double>").select(model.column(F.col("s")).alias("p")).toPandas()["p"]
    assert np.allclose(cols, model.score(x[:50]))
    labels = spark.createDataFrame([(1, 1), (4, 1), (11, 0), (5, None), (99, 1), (None, 1)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0)):
        m = rule_quality.train(docs, lab)
        rows = rule_quality.scored(docs, m).select("row.doc_id", "score").collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert rule_quality.scored(none, model).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    bpe = vocab.byte_bpe(token_counts.JSON, token_counts.RANKS)
    rows = {}
    for r in got:
        rows.setdefault((r.doc_id, r.piece), []).append(r)
    n = 0
    for i, t, _ in TEXTS:
        ids = np.array([*bpe.library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, length) in enumerate(packing.cut(len(ids), 2048)):
            n += 1
            r = rows[i, k].pop()
            assert (r.start, r.length, r.ids_crc32) == (s, length, zlib.crc32(ids[s : s + length].tobytes()))
    assert n == len(got)
    check_places(got, 2048)
    assert packing.pack(none).count() == 0


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_best_fit_is_best_fit_decreasing(spark):
    rng = np.random.default_rng(0)
    sizes = [*rng.integers(1, 101, 400).tolist(), *[37] * 300]
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "k long, length long")
    used = check_places(packing.best_fit(items, ["k"], "length", 100).collect(), 100)
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(100 - s)
    assert used == len(gaps)


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_warc(spark, split):
    long = "<html>" + "é" * 800
    rows = [(1, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (9, None, long), (3, "http://a/3", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "z" * 5000), (7, "u", "z" * 5000), (8, "u", "WARC/1.1\r\n\r\n" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(2)
    out = scratch(spark, "warc")
    manifest = warc.write_warc(pages, out, file_bytes=2000)
    got = warc.read_warc(manifest, out, split, with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id).encode()
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha1(html).hexdigest()
        assert r.record_type == ("revisit" if r.page_id in (1, 2, None) else "response") and r.refers_to == (9 if r.page_id in (1, 2, None) else None)
        assert (bytes(r.payload) == html) if r.record_type == "response" else r.payload is None
    none = pages.limit(0)
    assert warc.read_warc(warc.write_warc(none, out2 := scratch(spark, "warc")), out2).count() == 0


def test_licences(spark, docs, none):
    mit = licences.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit.upper()), (2, mit.replace("Software", "program")), (3, mit.replace(",", " ;").replace("sublicense", "sub-license")), (4, "Some text.\nReleased under the MIT Licence\nmore"), (5, None), (6, "Copyright 2020 X")]
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].licence, got[2].licence, got[3].licence) == ("MIT", None, "MIT")
    assert got[4].line_licences == "MIT" and got[4].licence is None
    assert got[5].canonical_words == got[6].canonical_words == 0
    assert licences.licence_scan(docs).count() == len(TEXTS) and licences.licence_scan(none).count() == 0


@pytest.mark.parametrize("width", [0, 30, 50, 68, 72, 76, 80])
def test_licences_wrapped(spark, width):
    """Wherever a line is broken, also before 'copyright', the licence is found; statements of a copyright still go."""
    heads = ["Copyright (c) 2020 Some One", "Copyright Some One and contributors", "# Copyright: 1999, 2001 Some One\nAll rights reserved.", "(c) 2016 Some One", "© Some One", "Copyright [yyyy] [name of copyright owner]"]
    breaks = [f"Copyright {w}" for w in ("notice", "HOLDERS", "holder", "owner")]
    known = {n: t for n, t in reversed(licences.KNOWN[:7])}
    rows = []
    for name, text in known.items():
        wrapped = "\n".join(textwrap.fill(x, width) if width else re.sub(r"(?i) (copyright )", r"\n\1", x) for x in text.split("\n"))
        assert width or any(b.lower() in wrapped.lower() for b in breaks)
        rows += [(f"{name} {k}", head + "\n\n" + wrapped) for k, head in enumerate(["", *heads])]
    got = licences.licence_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.licence for r in got} == {i: i.split()[0] for i, _ in rows}


def test_licences_at_every_width(spark):
    """Every known text up to 4,000 characters, wrapped at each width, by both canonical forms; only a statement of a copyright that is part of a text may not be cut."""
    rows = []
    for n, (name, text) in enumerate(licences.standard_texts()):
        if len(text) < 4000 and not name.endswith("-UC"):
            for w in range(40, 101, 1 if n < len(licences.KNOWN) else 7):
                rows.append((f"{n} {w}", "\n".join(textwrap.fill(x, w, break_long_words=False) for x in text.split("\n")), name))
    got = {r.doc_id: (r.licence, r.canonical_words, r.canonical_sha256) for r in licences.licence_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string").repartition(8)).collect()}
    for i, text, name in rows:
        w = licences.plain_words(text)
        assert got[i] == (name, len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()), i


def test_licences_from_a_large_table(spark, docs, none, monkeypatch):
    """The joins give the rows of the literal look-up."""
    known = spark.createDataFrame([*licences.standard_texts(), ("Own-1.0", "our own notice"), ("Empty", "")], "name string, text string")
    rows = spark.createDataFrame([(1, licences.KNOWN[0][1]), (1, licences.KNOWN[0][1]), (2, "Our own notice."), (3, "x\nour OWN notice\n" + licences.KNOWN[-1][1]), (4, None), (None, "our own notice")], "doc_id long, text string")
    plain = sorted(map(str, licences.licence_scan(rows, known=known).collect()))
    monkeypatch.setattr(licences, "MAX_KNOWN", 5)
    assert sorted(map(str, licences.licence_scan(rows, known=known).collect())) == plain and sum("Own-1.0" in r for r in plain) == 3
    assert licences.licence_scan(docs, known=known).count() == len(TEXTS) and licences.licence_scan(none, known=known).count() == 0


def test_licences_entire_texts(spark):
    """Entire texts with and without appendix, and short licences under their titles."""
    full = {p.stem: p.read_text("utf-8") for p in licences.TEXTS.glob("*.txt")}
    rows = [(f"{name.partition('+')[0]} {name}", "Copyright 2021 Some One\n" + text.upper()) for name, text in full.items()]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0", "CC-BY-SA-4.0"} <= set(full)
    rows += [("Apache-2.0 bare", full["Apache-2.0"].partition("END OF TERMS")[0]), ("GPL-2.0 bare", full["GPL-2.0"].partition("How to Apply")[0])]
    bsd2, bsd3 = (t for n, t in licences.KNOWN if n.startswith("BSD"))
    for title in ("BSD 3-Clause License", "New BSD License", "The 3-Clause BSD License"):
        rows.append((f"BSD-3-Clause {title}", f"{title}\n\nCopyright (c) 2021, Some One\nAll rights reserved.\n\n{bsd3}"))
    rows += [("BSD-2-Clause stars", "Simplified BSD License\n" + re.sub(r"(?m)^\d\.", "*", bsd2)), ("Zlib title", "zlib License\n" + licences.KNOWN[7][1]), ("MIT title", "(The MIT License)\n" + licences.KNOWN[0][1]), ("ISC title", "The ISC License\n" + licences.KNOWN[3][1])]
    got = licences.licence_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.licence for r in got} == {i: i.split()[0] for i, _ in rows}
    assert all(r.canonical_sha256 for r in got)


def plain_best_fit(counts, capacity):
    """Sorted loads by best-fit decreasing, piece by piece."""
    gaps = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fit = min((g for g in gaps if g >= size), default=None)
            if fit is None:
                fit = capacity
            else:
                gaps.remove(fit)
            gaps.append(fit - size)
    return sorted(capacity - g for g in gaps)


def test_sweep_is_best_fit_decreasing():
    rng = np.random.default_rng(0)
    tables = [{52: 6, 37: 5, 31: 8, 23: 7}, {20: 7}, {}]
    for _ in range(3000):
        sizes = rng.choice(np.arange(1, 101), int(rng.integers(1, 7)), replace=False)
        tables.append({int(s): int(rng.integers(1, 13)) for s in sizes})
    for counts in tables:
        matched, loads, taken = packing.sweep(counts, 100), {}, {}
        ends = {a[:2]: b[1] if b and b[0] == a[0] else counts[a[0]] for a, b in zip(matched, [*matched[1:], None])}
        for size, rank, first, offset in matched:
            for k in range(ends[size, rank] - rank):
                assert loads.get(first + k, 0) == offset  # pieces neither overlap nor leave a gap between
                loads[first + k] = offset + size
                taken[size] = taken.get(size, 0) + 1
        assert taken == counts and sorted(loads.values()) == plain_best_fit(counts, 100), counts


def test_stages_that_learn_nothing_keep_their_input(spark, docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("none", labels), ("other", spark.createDataFrame([(99, 1, 0)], labels.schema)), ("one", spark.createDataFrame([(1, 0, 0)], labels.schema))):
        rows.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert stages.quality_stage(spark, docs, f"{tmp_path}/{name}").count() == len(TEXTS)
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = stages.language_stage(spark, bare, "")
    assert kept.columns == bare.columns and kept.count() == len(TEXTS)
    digits = docs.withColumn("lang", F.when(F.col("doc_id") == 8, F.col("lang")))
    assert stages.language_stage(spark, digits, "").count() == len(TEXTS)


def plain_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            u, i = len(sets[a] | sets[b]), len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= percent * u:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(i, low[r])
    return sorted((str(i), len(sets[k]), str(low[find(k)]), links[k]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("words", "percent", "tile"), [(3, 90, None), (5, 80, None), (3, 90, 400), (5, 80, 400)])
def test_jaccard(spark, words, percent, tile, monkeypatch):
    if tile:
        monkeypatch.setattr(jaccard_join, "TILE", tile)
        monkeypatch.setattr(jaccard_join, "HELD", 500)
    rng = np.random.default_rng(words)
    rows = [(i, t) for i, t, _ in TEXTS] + [(90, " ".join(f"w{k}" for k in range(6000))), (91, " ".join(f"w{k}" for k in range(5990)))]
    for k in range(12):
        base = [f"w{v}" for v in rng.integers(0, 500, int(rng.integers(3, 150)))]
        for j in range(8):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = f"x{rng.integers(9)}"
            rows.append((100 + 10 * k + j, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).repartition(4)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in jaccard_join.jaccard_components(df, words=words, percent=percent).collect())
    assert got == plain_components(rows, words, percent)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_segments_agree_for_linked_sets():
    """Every linked pair shares a key, whatever its size."""
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        cuts = jaccard_join.Cuts(percent)
        for n in [*range(2, 60), 100, 333, 700, 1500]:
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for _ in range(3):
                drop = int(rng.integers(0, cuts.differ(len(a)) + 1))
                add = int(rng.integers(0, max(1, len(a) * 100 // percent - len(a) + 1)))
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
                i, u = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if 100 * i >= percent * u and i != u:
                    (x, need), (y, _) = cuts.keys(a), cuts.keys(b)
                    assert len(np.intersect1d(x, y)) >= max(1, need), (percent, n, len(a), len(b))


def test_stages(spark, docs, none, tmp_path):
    labels = spark.createDataFrame([(i, int(i != 11)) for i in range(1, 14)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (stages.language_stage, stages.quality_stage, stages.near_duplicate_stage):
        path = str(tmp_path / stage.__name__)
        docs.write.parquet(path)
        kept = stage(spark, spark.read.parquet(path), str(tmp_path))
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect()]
        assert 4 in ids and (stage is not stages.language_stage or not {5, 6, 7, 8} & set(ids))
        if stage is stages.near_duplicate_stage:
            assert ids.count(12) == 1 and 2 not in ids and 1 in ids and {5, 6, 7} <= set(ids)
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows
    check_places(rows, 2048)
