"""Training-data operators against brute force, round trips and held-out accuracy, on small and awkward inputs."""

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reapline.llm import chat, decontaminate, langid, mixing, mtree, neardup, quality, tokens, toxicity, warc
from reapline.llm.components import components
from reapline.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, vector string"


def docs_of(spark, texts, source="s"):
    rows = [(i, t, "en", source, None if t is None else len(t), "clash", None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "two words"), (6, "é\x00 x"), (None, "no id here"), (8, "w " * 30_000), (8, "w " * 30_000)]


# near duplicates

def brute_components(texts, n, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = {i: shingles(t) for i, t in texts}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    base = words(120, 1).split()
    texts = [(i, words(60, i)) for i in range(10, 16)]
    for i in range(20, 50):  # a group around the threshold: some links only through others
        rng = np.random.default_rng(i)
        own = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 6)):
            own[p] = f"x{i}"
        texts.append((i, " ".join(own)))
    texts += [(60, "A b"), (61, "a B"), (62, "a b c"), (63, None), (64, ""), (65, None), (66, words(60, 10).upper())]
    out = neardup.near_duplicates(docs_of(spark, texts), 3, 85).collect()
    expected = brute_components(texts, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_crowded_buckets_are_complete(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(neardup, "STAR", 2)
    base = words(100, 2).split()
    texts = [(i, " ".join(base[: 100 - i % 12] + [f"y{i}"] * (i % 5))) for i in range(40)]
    out = neardup.near_duplicates(docs_of(spark, texts), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(texts, 3, 85)


def test_a_crowded_bucket_of_unlike_documents_stays_linear(spark):
    """Thousands of members, half alike as far as sketches tell, none linked: each leaves its group at most once, and links never outnumber components."""
    rng = np.random.default_rng(8)
    base, n = rng.integers(0, 256, neardup.SKETCH).astype(np.uint8), 5000
    sketches = np.where(rng.random((n, neardup.SKETCH)) < 0.12, rng.integers(0, 256, (n, neardup.SKETCH)), base).astype(np.uint8)
    uid = np.arange(n)
    rows = [("bucket", np.zeros(2 * n, np.int64)), ("left_block", np.zeros(2 * n, np.int32)), ("right_block", np.zeros(2 * n, np.int32)), ("side", np.repeat([0, 1], n).astype(np.int32)),
            ("uid", np.tile(uid, 2)), ("comp", np.tile(uid, 2)), ("n_shingles", np.full(2 * n, 100))]
    table = pa.table({**dict(rows), "sketch": [s.tobytes() for s in sketches] * 2})
    found = pa.Table.from_batches(neardup._plausible(iter(table.to_batches()), 85))
    assert n < found.num_rows <= 2 * n
    unpacked = pa.table({c: found[c] for c in ("bucket", "left_block", "right_block", "side", "uid", "comp")})
    texts = {i: " ".join([f"w{k}" for k in range(60)] + [f"own{i}x{k}" for k in range(20)]) for i in range(300)}
    ids = {i: neardup.fingerprint(neardup.shingle_set(t, 3))[0] for i, t in texts.items()}
    packer = zstandard.ZstdCompressor()
    small = unpacked.filter(pc.less(unpacked["uid"], 300)).to_pylist()
    for r in small:
        r["packed"], r["uid"] = packer.compress(texts[r["uid"]].encode()), ids[r["uid"]]
    small = pa.Table.from_pylist(small)
    assert sum(b.num_rows for b in neardup._met(iter(small.to_batches()), 3, 85)) == 0
    links = pa.Table.from_batches(neardup._met(iter(small.to_batches()), 3, 50))
    assert links.num_rows == len({r["uid"] for r in small.to_pylist()}) - 1


def test_one_row_of_each_component_stays(spark):
    """Null ids and texts without words stay; repeats go; an id with two texts is judged text by text; names clash."""
    long, other, third = words(60, 1), words(60, 2), words(60, 3)
    rows = [(1, long, "a"), (1, long, "a"), (2, long + " more", "b"), (None, long, "c"), (None, long, "c"), (3, other, "d"), (4, other, "e"), (4, third, "f"), (5, third, "g"),
            (6, "", "h"), (6, "", "h"), (7, None, "i"), (8, long.upper(), "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumns({"uid": F.lit(1), "n": F.lit(2), "component": F.lit(3)})
    out = neardup.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r["_id"] for r in out.collect()) == ["a", "c", "c", "d", "f", "h", "h", "i"]


def test_near_duplicates_of_awkward_rows(spark):
    out = neardup.near_duplicates(docs_of(spark, AWKWARD), 5, 80).collect()
    assert len(out) == len(AWKWARD)
    by = {r.doc_id: r for r in out}
    assert by[None].component_id is None and not by[None].kept
    assert [by[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert [r.kept for r in out if r.doc_id == 8] == [True, True]
    empty = docs_of(spark, AWKWARD).limit(0)
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.drop_near_duplicates(docs_of(spark, AWKWARD)).columns == docs_of(spark, []).columns


def test_signature_is_circulant():
    first, shifts = neardup._permutations()
    found = neardup.shingle_set("a b c d e f", 2)
    places = [int(first[int(x) & (neardup.UNIVERSE - 1)]) for x in found]
    ring = shifts[:, 0]
    expected = [min(int(ring[(p + k) % neardup.UNIVERSE]) for p in places) for k in (0, 1, 383)]
    assert neardup.signature(found)[[0, 1, 383]].tolist() == expected


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    table = spark.createDataFrame(links, "a long, b long")
    out = {r.node: r.component for r in components(table).collect()}
    assert out == {r.node: r.component for r in components(table, one_task=5).collect()} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


# quality and toxicity

def test_pair_term_by_sum_of_squares():
    rng = np.random.default_rng(0)
    machine = quality.FactorisationMachine(0.3, rng.normal(size=1 << 18), rng.normal(0, 0.3, (1 << 18, quality.RANK)))
    features, values = np.array([5, 9, 77, 1000]), np.array([0.5, 1.0, 0.25, 0.7])
    pairs = sum(machine.factors[a] @ machine.factors[b] * x * y for i, (a, x) in enumerate(zip(features, values)) for b, y in list(zip(features, values))[i + 1 :])
    raw = 0.3 + machine.linear[features] @ values + pairs
    assert machine.score([(features, values)])[0] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_of_awkward_rows(spark):
    docs = docs_of(spark, AWKWARD)
    labels = spark.createDataFrame([(2, None), (None, 1), (4, 1), (4, 0), (5, 1)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out)
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert quality.keep_quality(docs.limit(0), labels).count() == 0
    assert quality.keep_quality(docs, labels.limit(0)).schema == docs.schema


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    out = toxicity.toxicity(docs_of(spark, AWKWARD), labels.limit(0)).collect()
    assert len(out) == len(AWKWARD) and {r.grade for r in out} == {0}


def test_ordered_grades_share_weights():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(600):
        grade = int(rng.integers(0, 4))
        rows.append((grade, np.unique(np.concatenate([rng.integers(100, 200, 8), np.arange(grade)]))))
    model = toxicity.OrdinalModel.fit(rows)
    above = model.chances([f for _, f in rows])
    assert (np.diff(above, axis=1) <= 1e-12).all()
    assert np.abs(above.sum(axis=1) - [g for g, _ in rows]).mean() < 0.5


# language

def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    out = langid.identify(docs_of(spark, AWKWARD)).collect()
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert all(0 <= r.score <= 1 for r in out)
    nothing = langid.identify(docs_of(spark, AWKWARD).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_languages_without_blanks(spark):
    rng = np.random.default_rng(6)
    letters = {"en": "abcdefgh", "ja": [chr(0x3042 + i) for i in range(60)], "zh": [chr(0x4E00 + i) for i in range(300)]}
    known = {lang: ["".join(rng.choice(list(own), 3)) for _ in range(60)] for lang, own in letters.items()}
    text = lambda lang, i: (" " if lang == "en" else "").join(rng.choice(known[lang], 200 if i % 2 else 40))
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(list(letters) * 40)]
    docs = spark.createDataFrame(rows + [(900, "word", "one")], "doc_id long, text string, lang string")
    content = langid.dictionaries(docs)
    assert set(content) == {"en", "ja", "one", "zh"} and all(content.values())
    assert all(len(content[x].decode()) > 2000 for x in ("ja", "zh"))
    found = langid.identify(docs).join(docs, "doc_id").where("held_out and lang <> 'one'").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.95


def test_excerpt_borders():
    assert langid.excerpt("two words") == b"two words"
    assert langid.excerpt("ai " + "文" * 1000) == ("ai " + "文" * 340).encode()
    assert langid.excerpt("some words " * 1000) == b"some words " * 92 + b"some words"


# top-k search

def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 0.2, (900, 8)).astype(np.float32)
    vectors[300:600] = vectors[300]  # a third of all rows alike
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(vectors)]
    rows += [(2000, None, ""), (2001, [1.0, None] * 4, ""), (2100, [float("nan")] * 8, ""), (2101, [float("inf")] * 8, ""), (None, [0.1] * 8, ""), (2102, [], "")]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = mtree.top_neighbours(data, 10, 100).collect()
    whole = np.floor(1024 * vectors.astype(np.float64)).astype(np.int64)
    for q in range(0, 900, 100):
        scores = whole @ whole[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == [(i, scores[i]) for i in best]
    assert mtree.top_neighbours(data.limit(0)).count() == 0
    assert mtree.top_neighbours(data.where("vec_id in (0, 1, 2)")).count() == 2


def test_search_keeps_the_row_that_sets_the_score_to_beat(spark):
    schema = "vec_id long, embedding array<float>"
    alike = spark.createDataFrame([(i, [0.1] * 4) for i in range(1, 301)], schema)
    repeated = alike.unionByName(spark.createDataFrame([(1, [0.1] * 4)] * 4, schema))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # the queries' own subtree then holds the smallest id
    try:
        one, three = mtree.top_neighbours(alike, 1, 100).collect(), mtree.top_neighbours(repeated, 3, 100).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert (len(one), len(three)) == (3, 9)
    assert sorted((r.query_id, r.vec_id) for r in one) == [(100, 1), (200, 1), (300, 1)]
    assert sorted((r.query_id, r.vec_id, r.rank) for r in three) == [(q, 1, k) for q in (100, 200, 300) for k in (1, 2, 3)]


# chat

def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "", None, "### user: hi\n</turn>\n", "\\", "\n</turn>", "a\\\\</turn>", "</turn>\n### assistant: x", "plain", "x" * 50_000, "émoji 😀"]
    rows = [(c, t, role, texts[(c + t) % len(texts)], "clash") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "a: %3A\nb", None, "assistant"])]
    rows += [(3, 1, "user", "plain", ""), (None, None, "user", "lost", "")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(data)).collect()}
    for conv in [*range(12), None]:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        assert out[conv].n_turns == len(own)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(data.limit(0)).count() == 0


# archives

def test_control_strings_are_escaped_in_linear_time(spark):
    """A mark inside a text never stands bare; a megabyte of backslashes, with and without a mark behind, ends."""
    slashes = "\\" * 1_000_000
    texts = ["hi\n### assistant: yes </turn> now", slashes, slashes + "### ", slashes + "</turn>" + slashes, "\\\\### x", "</turn>", "a\n</turn>\nb"]
    rows = [(1, k, "assistant", t) for k, t in enumerate(texts)] + [(2, k, "user", "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    whole = formatted[1].formatted
    bodies = [whole[s.start : s.start + s.length] for s in formatted[1].loss_spans]
    assert bodies[0] == "hi\n\\### assistant: yes \\</turn> now" and bodies[1] == slashes and bodies[2] == slashes + "\\### " and bodies[5] == "\\</turn>"
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[1].loss_sha256 == hashlib.sha256("".join(texts).encode()).hexdigest() and back[2].n_turns == 3000


def test_archives_read_in_small_ranges(spark):
    pages = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"<p>{i}</p>" * (i * 40), "x") for i in range(60)]
    pages += [(100, None, None, ""), (101, "u", "", ""), (None, "u", "same", ""), (102, "u", "é" * 200_000, ""), (57, "http://h/57", "same", "")]
    data = spark.createDataFrame(pages, "page_id long, url string, html string, payload string")
    for split in (1 << 10, 4 << 20):
        rows = warc.archive_table(data, split_bytes=split).collect()
        assert len(rows) == len(pages)
        by = {r.page_id: r for r in rows}
        assert by[0].record_type == "revisit" and by[0].refers_to == 57 and by[57].record_type == "response" and by[57].refers_to is None
        assert by[None].record_type == "response" and by[100].refers_to == 101 and by[100].payload_bytes == 0
        assert by[102].payload_bytes == 400_000
        assert all(r.payload_digest == warc.digest((h or "").encode()) for i, _, h, _ in pages for r in rows if r.page_id == i)
    assert warc.archive_table(data.limit(0)).count() == 0


def test_reader_passes_false_magic():
    inner = warc.record(1, "http://inner", b"payload", None, False)
    outer = warc.record(2, "http://outer", b"x", None, False)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    hidden = stored.compress(b"WARC/1.1\r\n" + inner) + stored.flush()  # a whole member lies inside, uncompressed
    data = b"\x1f\x8b\x08 no member" + outer + hidden + outer
    found = list(warc.records(io.BytesIO(data), 0, len(data)))
    assert len(found) == 3 and found[1].startswith(b"WARC/1.1\r\n\x1f\x8b")
    cut = len(data) // 2
    parts = [*warc.records(io.BytesIO(data), 0, cut), *warc.records(io.BytesIO(data), cut, len(data))]
    assert parts[0] == found[0] and parts[-1] == found[-1]


# tokens

def test_token_files(spark):
    rows = [*AWKWARD, (11, "plain words, and more. Then\nlines"), (12, "  two  blanks \n end "), (13, "<|endoftext|> it's 12 !!"), (14, words(3000, 5))]
    whole = Tokenizer.from_file(tokenizer_path())
    expected, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = tokens.token_table(docs_of(spark, rows), tokenizer_path()).collect()
    assert sorted(map(tuple, out), key=lambda r: r[1]) == expected
    assert tokens.token_table(docs_of(spark, []), tokenizer_path()).count() == 0


def test_direct_access():
    ids = np.array([0, 255, 256, 65_535, 65_536, 1 << 24, 2**32 - 1, 2] * 500, np.uint32)
    found = tokens.Segment(tokens.segment([1, None], [ids[:100].tobytes(), ids[100:].tobytes()]))
    assert [found.token(i) for i in range(len(ids))] == ids.tolist()
    assert (found.tokens(511, 2900) == ids[511:2900]).all() and not len(found.tokens(5, 5))


# mixing

def test_exponent_meets_its_target():
    counts = [1000, 100, 10]
    a = mixing.exponent_for(counts, max_repeats=4.0)
    assert mixing.repeats(counts, mixing.tempered(counts, a)) == pytest.approx(4.0)
    b = mixing.exponent_for(counts, target_entropy=0.9)
    assert mixing.entropy(mixing.tempered(counts, b)) == pytest.approx(0.9)
    assert mixing.exponent_for(counts, target_entropy=0.0) == 1.0 and mixing.exponent_for([0, 0]) == 1.0


def test_mixture_spends_its_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    rows = [(i, words(5 + i % 7, i), "en", "big" if i % 3 else None, 0, "", "") for i in range(300)] + [(900, None, "en", "void", 0, "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mixture(docs, max_repeats=1.2, budget=1500).collect()
    assert len(out) == len(rows)
    for source in ("big", None):
        own = [r for r in out if r.source == source]
        quota = 1500 * own[0]._weight
        spent = sum(r._copies * r._tokens for r in own)
        assert quota - 1 <= spent < quota + 12
        assert max(r._copies for r in own) - min(r._copies for r in own) <= 1
    kept = mixing.mix(docs, max_repeats=1.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows}
    assert mixing.mix(docs.limit(0)).count() == 0


# decontamination

@pytest.mark.parametrize("budget", [None, 1500, 0])
def test_sequences_against_a_walk_through_the_permutations(spark, monkeypatch, budget):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    big = docs_of(spark, [(i, words(1 + i % 9, i)) for i in range(120)], "big")
    docs = big.unionByName(docs_of(spark, [(500 + i, words(4, i)) for i in range(20)], "small")).unionByName(docs_of(spark, AWKWARD[:7], None)).cache()
    parts = dict(max_repeats=1.2, budget=budget, seed=5)
    got = sorted((r.source or "", r._pass, r._position, r.doc_id or -1, r._tokens) for r in mixing.permuted(docs, **parts).collect())
    weights = mixing.source_weights({r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.token_count()).alias("n")).collect()}, None, 1.2, budget)
    hashed = lambda *parts: F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])
    want = []
    for name, (_, quota) in weights.items():
        mine = docs.where(F.col("source").eqNullSafe(F.lit(name))).withColumn("n", mixing.token_count())
        total = mine.agg(F.sum("n")).first()[0]
        count = max(1, -(-total // 50))
        rows = [tuple(r) for r in mine.select(F.pmod(hashed(6, F.col("doc_id")), F.lit(count)), hashed(5, F.col("doc_id")), "doc_id", "n").collect()]
        full = quota // total
        for turn in range(full + (1 if quota % total else 0)):
            keys = {b: k for b, k in spark.range(count).select("id", hashed(7 + full - turn, F.col("id"))).collect()}
            at = 0
            for _, _, doc, n in sorted(((r[0], r[1], r[2], r[3]) for r in rows), key=lambda r: (keys[r[0]], r[1], r[2] or -1, r[3])):
                if turn < full or at < quota % total:
                    want.append((name or "", turn, turn * total + at, doc or -1, n))
                at += n
    assert got == sorted(want)
    copies = {(r.doc_id, r.source): r._copies for r in mixing.mixture(docs, **parts).collect()}
    assert sum(copies.values()) == len(got)


def test_sequences_of_awkward_rows(spark):
    df = docs_of(spark, AWKWARD).withColumns({c: F.lit(7) for c in ("_pass", "_position", "_name", "_begin", "_inside", "_full")})
    out = mixing.permuted(df)
    assert out.columns == [c for c in df.columns if c not in ("_pass", "_position")] + ["_tokens", "_weight", "_pass", "_position"]
    rows = out.collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 3, 4, 5, 6, 8, 8] and {r._name for r in rows} == {7}
    spans = sorted((r._position, r._position + r._tokens) for r in rows if r._tokens)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
    assert mixing.permuted(df.limit(0)).count() == 0


def test_mixing_leaves_texts_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 8)
    docs = docs_of(spark, [(i, "w " * (i % 5)) for i in range(60)], "a").unionByName(docs_of(spark, [(i, "v") for i in range(60, 70)], "b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mix(docs, max_repeats=1.5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_mixing_with_columns_of_any_name(spark):
    """Columns named like the operator's own pass through; null, empty and repeated rows keep their copies."""
    rows = [(i, words(30, i), "big") for i in range(12)] + [(50, words(5, 3), "small"), (50, words(5, 3), "small"), (51, None, None), (52, "", None)]
    clashing = ("_name", "_block", "_blocks", "_rest", "_full", "_order", "_last", "_row", "_copy", "_tokens", "_weight", "_copies")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(99) for c in clashing})
    out = mixing.mix(df, max_repeats=1.5)
    plain = mixing.mix(df.drop(*clashing), max_repeats=1.5)
    assert out.columns == df.columns and {r["_tokens"] for r in out.collect()} == {99}
    assert sorted(map(str, out.select("doc_id").collect())) == sorted(map(str, plain.select("doc_id").collect()))
    assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
    assert mixing.mixture(df).columns == [c for c in df.columns if c not in ("_tokens", "_weight", "_copies")] + ["_tokens", "_weight", "_copies"]


def test_contaminated_documents(spark):
    items = [(i, f"{words(20, 100 + i)}? {words(8, 200 + i)}.") for i in range(30)] + [(50, None), (51, "too short"), (52, "")]
    docs = [(i, words(200, 300 + i)) for i in range(20)]
    docs += [(100, f"{words(90, 1)} {items[3][1].upper()} {words(50, 2)}"), (101, items[4][1]), (102, " ".join(items[5][1].split()[:8])), *AWKWARD]
    data, bench = docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contaminated(data, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(100, 3), (101, 4)}
    kept = decontaminate.drop_contaminated(data, bench)
    assert kept.schema == data.schema and kept.count() == len(docs) - 2
    assert decontaminate.contaminated(data, bench.limit(0)).count() == 0 and decontaminate.contaminated(data.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [2, 16])
def test_retrieval_equals_brute_force(monkeypatch, block):
    """Block-max WAND against scoring every passage with every item; some words are in most items."""
    monkeypatch.setattr(decontaminate, "BLOCK_POSTINGS", block)
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(300)]
    draw = lambda n: [w.encode() for w in rng.choice(vocabulary, n, p=share)]
    share = np.array([1 / (i + 5) for i in range(300)]) / sum(1 / (i + 5) for i in range(300))
    items = [(i, draw(int(rng.integers(1, 60))), draw(i % 6)) for i in range(400)]
    df = {}
    for _, q, a in items:
        for w in set(q + a):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index(items, df, 400, 30.0)
    texts = [draw(60) + items[i][1] + items[i][2] + draw(int(rng.integers(0, 300))) for i in range(50)] + [[], [b"none"]]
    codes = [np.array([index.vocabulary.get(w, len(index.vocabulary)) for w in t], np.int32) for t in texts]
    found = {(d, i): s for d, i, s in index.retrieve(np.concatenate(codes), np.array([len(c) for c in codes]))}
    expected = {}
    assert sum(len(c.item) for c in index.classes) == 400 and all(n > 0 for c in index.classes for n in c.need)
    for d, own in enumerate(codes):
        for part in index.classes:
            for start in range(0, max(1, -(-(len(own) - part.stride) // part.stride)) * part.stride, part.stride):
                words = set(own[start : start + 2 * part.stride].tolist())
                for item, threshold, weights in zip(part.item, part.threshold, part.weights):
                    score = sum(w for t, w in weights.items() if t in words)
                    if score >= threshold:
                        expected[d, item] = max(expected.get((d, item), 0), score / decontaminate.SCALE)
    assert found == expected and {index.ids[i] for _, i in found} >= set(range(50))


def test_short_items_and_very_long_texts(spark):
    items = [(1, "lone"), (2, "so long"), (3, "who? me"), (4, words(30, 7)), (5, "...")]
    docs = [(1, "a lone word"), (2, "alone"), (3, "long so"), (4, "and So, LONG!"), (5, "me, who"), (6, "he said: who? me!"), (7, f"{words(300_000, 8)} {items[3][1]} {words(100, 9)}")]
    out = decontaminate.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 1), (4, 2), (6, 3), (7, 4)}


# the pipeline

def test_pipeline_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns, name
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    kept = {r.doc_id for r in out.collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(kept & good) > 0.8 * len(good)
