"""The operators against plain Python, on the smallest tables and on awkward rows."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from legajo.llm import chat_format, common, components, decontaminate, hilbert, jaccard_join, language_id, mixture, perplexity, quality_rules, substring_dedup, token_counts
from legajo.llm.text import SPACE, Words, slices
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, size int, target double, copies int, score double, positions string"
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "A b c",
    "É" * 5,
    PASSAGE,
    PASSAGE,
    "new start " + PASSAGE,
    PASSAGE.replace("word30", "other"),
    "x " * 3000,
    "w" * 100_000,
    "line\nline\n\nline\n" + PASSAGE.upper(),
    "a b c d \x1c e\x0bf",
]


def _docs(spark, ids, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, len(t) if t is not None else None, 7, "r", 3, 0.5, 9, 0.1, "p") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def plain(spark):
    """Distinct ids."""
    return _docs(spark, range(len(TEXTS)), TEXTS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, ids that several texts share, rows repeated in full, a null source and language."""
    a = _docs(spark, [1, 1, 1, 2, None, None, 3, 3], [PASSAGE, PASSAGE, "other text here " + PASSAGE, PASSAGE, PASSAGE, None, "", "tiny"])
    return a.union(_docs(spark, [5, 5], [PASSAGE[:200]] * 2, None, None))


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [], [])


@pytest.fixture(scope="module")
def real(spark):
    return common.tune(spark).read.parquet(f"{DATA}/documents.parquet")


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# --- words -------------------------------------------------------------------


def test_words_equal_regex():
    texts = [t or "" for t in TEXTS]
    w = Words(pa.array(texts), SPACE)
    own = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert own == [x for t in texts for x in brute.SPACED.findall(t)]
    by_word = {}
    for x, h in zip(own, w.hash.tolist(), strict=True):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_slices_cover_all_rows():
    batch = pa.record_batch([pa.array(["a" * 50] * 10)], names=["text"])
    assert sum(b.num_rows for b in slices([batch], "text", 120)) == 10


# --- op1 ---------------------------------------------------------------------


@pytest.mark.parametrize("bits", [24, 7])
def test_decontaminate(spark, plain, bits):
    items = [(1, PASSAGE), (2, "one"), (2, "one"), (3, None), (4, "zzz unseen"), (10, "a b C"), (None, "other")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(plain, bench, bits=bits).collect()
    want = brute.decontaminate(_pairs(plain), [x for x in items if x[0] is not None])
    hit = {r.doc_id: (r.n_words, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated) for r in got}
    assert {k: (v[0], v[2], v[3]) for k, v in want.items()} == {k: v[:3] for k, v in hit.items()}
    assert [k for k, v in want.items() if v[4] and not hit[k][3]] == []


def test_decontaminate_real(spark, real):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.op1_decontaminate(spark, DATA).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == brute.decontaminate(_pairs(real), [tuple(r) for r in bench.select("item_id", "text").collect()])


def test_decontaminate_odd_and_empty(spark, odd, empty):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    assert decontaminate.contamination(empty, bench).count() == 0
    none = bench.where("false")
    assert {r.n_hit for r in decontaminate.contamination(odd, none).collect()} == {0}
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r.text or "" for r in kept.collect()) == ["", "", "tiny"]


def test_proximity(spark):
    texts = common.tune(spark).createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x x x x b")], "key long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    index = decontaminate.Index(texts, bench)
    assert {r.key for r in index.proximity_matches(2).collect()} == {1, 2}


def test_decontaminate_long_text(spark):
    """One text over the 2 MB of a slice, another of a single word as long."""
    long = " ".join(f"w{i % 90_000}" for i in range(400_000))
    docs = _docs(spark, range(3), [long + " " + PASSAGE + " tail", "q" * 3_000_000, PASSAGE])
    items = [(1, PASSAGE), (2, "q" * 3_000_000), (3, " ".join(f"w{i}" for i in range(5, 20)))]
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated) for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.decontaminate(_pairs(docs), items)


# --- op2 ---------------------------------------------------------------------


def test_chat_round_trip():
    rng = random.Random(2)
    bits = ["<", "\\", "s>", "</s>", "[", "INST]", "[/INST]", "<|turn|>", "<|end|>", "a", "\n", "<|image|>", "]", "<|content|>"]
    for _ in range(3000):
        role, text, more = ("".join(rng.choice(bits) for _ in range(rng.randint(0, 7))) for _ in range(3))
        parts = [chat_format.Part("text", text), chat_format.Part("image", ref="i", tokens=9), chat_format.Part("text", more), chat_format.Part("audio", tokens=4)]
        body, spans, attached = chat_format.format_turn(role, parts)
        ((got, found),) = chat_format.parse(body)
        assert got == role
        assert [(p.type, p.text) for p in found if p.type != "text" or p.text] == [(p.type, p.text) for p in parts if p.type != "text" or p.text]
        assert [body[at : at + len(chat_format.PLACEHOLDERS[k])] for k, _, _, at in attached] == ["<|image|>", "<|audio|>"]
        assert "".join(chat_format.unescape(body[a:b]) for a, b in spans) == text + more
        assert sum(n for _, _, n, _ in attached) == 13
    with pytest.raises(ValueError):
        chat_format.format_turn("u", [chat_format.Part("video")])


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", None), (1, 1, "assistant", "B"), (None, None, None, "x"), (2, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == brute.sha("user\n\nassistant\nB\nassistant\nB\n") and got[1].loss_sha256 == brute.sha("BB")
    assert got[None].turns_sha256 == brute.sha("\nx\n") and got[2].loss_chars == 0
    assert chat_format.read_back(chat_format.format_conversations(turns.where("false"))).count() == 0


def test_chat_content(spark):
    """All kinds of parts through Spark and back, without a column of texts."""
    parts = [("text", "a <|image|> b", None, None), ("image", None, "s3://i", 9), ("text", "c", None, None), ("text", "d", None, None), ("audio", None, "s3://a", 4), ("document", None, "s3://d", 70)]
    kind = "array<struct<type:string,text:string,ref:string,tokens:int>>"
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "</s>", None, None)]), (2, 0, "user", [])], f"conv_id long, turn long, role string, content {kind}")
    made = chat_format.format_conversations(turns)
    rows = {(r.conv_id, r.turn): r for r in made.collect()}
    assert rows[1, 0].n_expanded == 83 and [(a.kind, a.ref, a.tokens) for a in rows[1, 0].attachments] == [("image", "s3://i", 9), ("audio", "s3://a", 4), ("document", "s3://d", 70)]
    back = {(r.conv_id, r.turn): (r.role, [tuple(p) for p in r.content]) for r in chat_format.read_parts(made).collect()}
    assert back[1, 0] == ("user", [("text", "a <|image|> b", "", 0), ("image", "", "s3://i", 9), ("text", "cd", "", 0), ("audio", "", "s3://a", 4), ("document", "", "s3://d", 70)])
    assert back[1, 1] == ("assistant", [("text", "</s>", "", 0)]) and back[2, 0] == ("user", [("text", "", "", 0)])
    digests = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    assert digests[1].n_turns == 2 and digests[1].loss_sha256 == brute.sha("</s>")
    both = turns.where("conv_id = 1").withColumn("text", F.lit("unused")).unionByName(spark.createDataFrame([(3, 0, "user", None, "t")], f"conv_id long, turn long, role string, content {kind}, text string"))
    assert chat_format.read_parts(chat_format.format_conversations(both).where("conv_id = 3")).first().content[0].text == "t"
    with pytest.raises(ValueError):
        chat_format.format_conversations(turns.drop("content"))


def test_chat_reader_rejects_what_is_no_turn():
    body, _, attached = chat_format.format_turn("user", [chat_format.Part("image", ref="r", tokens=3)])
    ((_, (part,)),) = chat_format.parse(body, [(r, n) for _, r, n, _ in attached])
    assert (part.ref, part.tokens) == ("r", 3)
    for bad, given in ((body + "x", None), ("x" + body, None), (body[:-1], None), (body + "x" + body, None), (body, []), (body, [("r", 3)] * 2)):
        with pytest.raises(ValueError):
            chat_format.parse(bad, given)


def test_chat_long_conversation(spark):
    turns = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" <s> ")), 100).alias("text"))
    (r,) = chat_format.read_back(chat_format.format_conversations(turns)).collect()
    own = [(("user", "assistant")[i % 2], f"{i} <s> " * 100) for i in range(5000)]
    assert r.n_turns == 5000 and r.turns_sha256 == brute.sha("".join(f"{a}\n{b}\n" for a, b in own)) and r.loss_sha256 == brute.sha("".join(b for a, b in own if a == "assistant"))


# --- op3 ---------------------------------------------------------------------


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve(spark, n, bits):
    names = [f"c{i}" for i in range(n)]
    points = spark.createDataFrame(list(itertools.product(range(2**bits), repeat=n)), ", ".join(f"{c} int" for c in names))
    rows = points.withColumn("h", hilbert.hilbert_index([F.col(c) for c in names], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(2 ** (n * bits)))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in itertools.pairwise(rows))


def test_shards(spark, plain, odd, empty):
    for docs in (plain, odd, empty):
        got = hilbert.shard_documents(docs, 4).collect()
        assert len(got) == docs.count()
        counts = Counter(r.shard for r in got)
        if got:
            assert max(counts.values()) - min(counts.get(s, 0) for s in range(4)) <= 1
        for s in counts:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
        carried = hilbert.shard_documents(docs, 4, carry=True).select("shard", "slot", "doc_id").collect()
        assert sorted(map(str, carried)) == sorted(str(x) for x in hilbert.shard_documents(docs, 4).select("shard", "slot", "doc_id").collect())
    by_id = {r.doc_id: r for r in hilbert.shard_documents(plain, 4).collect()}
    assert all(by_id[i].size == len((t or "").encode()) + 1 and by_id[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in enumerate(TEXTS))


def test_shards_by_brute_force(spark, plain, odd):
    """Cells, curve, order and cuts against plain Python; the curve by walking all cells of a small grid."""
    for docs in (plain, odd.where("doc_id is not null").dropDuplicates(["doc_id", "text"])):
        rows = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.lang, r.source) for r in docs.collect()]
        values = list(zip(*[(r[0], r[1], r[3], r[4]) for r in rows], strict=True))

        def cell(column, v, cells=2**hilbert.BITS):
            known = sorted(x for x in column if x is not None)
            cuts = [known[max(0, -(-i * len(known) // cells) - 1)] for i in range(1, cells)] if known else []
            return 0 if v is None else sum(c < v for c in cuts)

        points = {tuple(cell(values[k], r[i]) for k, i in enumerate((0, 1, 3, 4))) for r in rows}
        grid = spark.createDataFrame(sorted(points), "a int, b int, c int, d int")
        place = {tuple(r)[:4]: r.h for r in grid.withColumn("h", hilbert.hilbert_index([F.col(c) for c in "abcd"], hilbert.BITS)).collect()}
        key = lambda r: (place[tuple(cell(values[k], r[i]) for k, i in enumerate((0, 1, 3, 4)))], r[0], r[2], r[1])
        want = []
        for rank, r in enumerate(sorted(rows, key=key)):
            shard = rank * 4 // len(rows)
            want.append((r[0], r[2], key(r)[0], shard, rank - -(-shard * len(rows) // 4)))
        assert sorted(tuple(r) for r in hilbert.shard_documents(docs, 4).select("doc_id", "text_crc32", "curve", "shard", "slot").collect()) == sorted(want)


def test_shard_pruning(spark, real):
    """Minimum and maximum of a shard rule most shards out for numbers, and hardly any wrongly kept for strings."""
    sharded = hilbert.shard_documents(real, 16)
    rows = sharded.collect()
    table = hilbert.manifest(sharded, ["doc_id", "size", "lang", "source"]).collect()
    whole = [max(r[f"max_{c}"] for r in table) - min(r[f"min_{c}"] for r in table) for c in ("doc_id", "size")]
    spans = [np.mean([r[f"max_{c}"] - r[f"min_{c}"] for r in table]) for c in ("doc_id", "size")]
    assert spans[0] < 0.8 * whole[0] and spans[1] < 0.8 * whole[1]
    kept = held = 0
    for c in ("lang", "source"):
        for v in {r[c] for r in rows}:
            own = {r.shard for r in rows if r[c] == v}
            may = {r.shard for r in table if r[f"min_{c}"] <= v <= r[f"max_{c}"]}
            assert own <= may
            kept, held = kept + len(may), held + len(own)
    values = len({r.lang for r in rows}) + len({r.source for r in rows})
    assert kept <= 1.3 * held and kept < 0.75 * 16 * values, (kept, held, 16 * values)


def test_shard_rows_keeps_all_columns(spark, plain):
    docs = plain.withColumn("a.b", F.lit(1)).withColumn("document", F.lit("d")).withColumn("shard", F.lit("old"))
    out = hilbert.shard_rows(docs, 4)
    assert out.columns == [c for c in docs.columns if c not in ("size", "shard")] + ["size", "text_crc32", "curve", "shard", "slot"]
    assert sorted((r.doc_id, r["a.b"], r.document, r.row) for r in out.collect()) == [(i, 1, "d", "r") for i in range(len(TEXTS))]


# --- op4 ---------------------------------------------------------------------


def _near_texts():
    rng = random.Random(4)
    words = [f"t{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(160)]
    texts = []
    for n in range(25):
        own = list(base)
        for _ in range(n % 7):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own[: 160 - n]))
    texts += [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 4, 5, 6, 7, 8, 9, 12, 15)]
    for n in (6, 8, 10, 14, 30):
        texts += [" ".join(words[:n]), " ".join(words[: n + 1]), " ".join(words[: n - 1]) + " z"]
    return texts


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_jaccard(spark, n, num):
    texts = _near_texts() + TEXTS
    docs = _docs(spark, range(len(texts)), texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, n, num).collect()}
    assert got == brute.jaccard(_pairs(docs), n, num)


@pytest.mark.parametrize("few", [128, 2])
def test_jaccard_near_the_threshold(spark, monkeypatch, few):
    """Copies of one text whose mutual similarity lies on both sides of the threshold."""
    monkeypatch.setattr(jaccard_join, "_FEW", few)
    monkeypatch.setattr(jaccard_join, "_LOAD", 4 if few > 2 else 0.3)
    rng = random.Random(11)
    words = [f"t{i}" for i in range(3000)]
    base, texts = [rng.choice(words) for _ in range(150)], []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    docs = _docs(spark, range(len(texts)), texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs).collect()}
    assert got == brute.jaccard(_pairs(docs))
    assert 1 < len({c for _, c in got.values()}) < 60


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_jaccard_by_rare_shingles(spark, monkeypatch, n, num):
    """Families around the threshold, all groups of which count as large."""
    monkeypatch.setattr(jaccard_join, "_FEW", 2)
    rng = random.Random(12)
    words = [f"t{i}" for i in range(300)]
    texts = []
    for size in (30, 60, 61, 90, 200):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(1, 1 + size // 40)):
                own[rng.randrange(len(own))] = rng.choice(words)
            at = rng.randint(0, size // 25)
            texts.append(" ".join(own[at:] if rng.random() < 0.5 else own[: len(own) - at]))
    docs = _docs(spark, range(len(texts)), texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs, n, num).collect()}
    assert got == brute.jaccard(_pairs(docs), n, num)
    assert 10 < len({c for _, c in got.values()}) < len(texts) - 10


def test_jaccard_template_makes_no_pairs(spark, monkeypatch):
    """Documents that share 60 words and differ in 6, at 0.826 all of them, are not compared with each other."""
    texts = [" ".join([f"c{i}" for i in range(60)] + [f"d{k}x{i}" for i in range(6)]) for k in range(600)]
    seen = []
    before = jaccard_join._links

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return before(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_links", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(_docs(spark, range(len(texts)), texts)).collect()}
    assert got == {i: i for i in range(600)} and sum(seen) <= 600 * 17


def test_jaccard_real(spark, real):
    got = {r[0]: tuple(r)[1:] for r in jaccard_join.op4_jaccard_join(spark, DATA).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute.jaccard(_pairs(real))


def test_jaccard_odd_and_empty(odd, empty):
    got = jaccard_join.similar_components(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.n_shingles == 57} == {1}
    assert jaccard_join.similar_components(empty).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == 5 and {"", None, "tiny", PASSAGE[:200]} < set(texts)


def test_sketch_bounds_difference():
    rng = np.random.default_rng(1)
    by = jaccard_join.bands(85, 100, 500)
    for _ in range(50):
        a = rng.integers(0, 2**63, 200).astype(np.uint64)
        k = int(rng.integers(0, 30))
        b = np.concatenate([a[k:], rng.integers(0, 2**63, k).astype(np.uint64)])
        band = np.array([int(np.searchsorted(by.low, 200, side="right")) - 1])
        x, y = (set(jaccard_join._sketch(v, np.array([200]), band, by)[0].tolist()) for v in (a, b))
        assert len(x - y) <= 2 * k


def test_components_in_rounds(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 201), (201, 100)]
    links = spark.createDataFrame(chain, "a long, b long")
    for per in (1 << 20, 7):
        got = {r.node: r.root for r in components.components(links, per).collect()}
        assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 200, 201)}


# --- op5 ---------------------------------------------------------------------


def test_language_accuracy(spark):
    out = language_id.op5_language_id(spark, "/root/testdata/sf0.01")
    held = out.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_profile_by_hand():
    def grams(text):
        c = Counter()
        padded = "".join(ch.lower() if ch.isalpha() else " " for ch in f" {text} ")
        for w in padded.split():
            w = f" {w} "
            for i in range(1, len(w) - 1):
                c[("1", w[i])] += 1
                c[("2", w[i : i + 2])] += 1
                c[("3", w[i - 1 : i + 2])] += 1
        return sorted(c.values())

    for t in ["ab abc", "É1é  x", "", "12", "a-b"]:
        assert sorted(language_id._counted([t])[2].tolist()) == grams(t)


def test_language_edges(spark, odd, empty, plain):
    learned = language_id.learn(plain)
    got = language_id.identify(plain, learned).collect()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(TEXTS)
    assert language_id.identify(odd, learned).count() == odd.count()
    assert language_id.identify(empty, learned).count() == 0
    many = language_id.identify(plain, language_id.learn(plain.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string"))), group=2))
    one = language_id.identify(plain, language_id.learn(plain.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))))
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    nothing = language_id.learn(empty)
    assert {r.lang_pred for r in language_id.identify(plain, nothing).collect()} == {"und"}


def test_language_by_brute_force(spark, real):
    """Ranks, distances and their ties, with profiles small enough that n-grams fall off their ends."""
    rows = real.orderBy("doc_id").limit(40).select("doc_id", "text", "lang").collect()
    train = [(r.text, r.lang) for r in rows[:20]] + [("ab ab ab", "tie1"), ("ab ab ab", "tie0"), ("123", "none")]
    tests = [r.text for r in rows[20:]] + ["ab ab", "", None, "12", "zq", "é" * 2_100_000 + " the of"]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    for size, top, group in ((400, 300, 1000), (30, 20, 3)):
        got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(asked, language_id.learn(docs, size, group), top).collect()}
        for i, text in enumerate(tests):
            lang, score = brute.language(train, text, size, top)
            assert got[i] == (lang, pytest.approx(score)), (i, size)


# --- op6 ---------------------------------------------------------------------


def test_token_splices():
    tokenizer = token_counts._tokenizer(token_counts.tokenizer_path())
    rng = random.Random(6)
    bits = ["a", "b ", " ", "  ", "\n", "<|endoftext|>", "<|endo", "'s", "é", "日本", "😀", "12", "!!", "\t", "word ", " the", "x" * 50, " " * 40]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["x" * 3000, " " * 3000, "ab" * 1500]
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        for chunk, overlap in ((64, 16), (300, 32)):
            assert [i for part in token_counts.spliced(tokenizer, t, chunk, overlap) for i in part] == want


def test_token_splices_without_boundary():
    """Text without any boundary costs a small multiple of one encoding."""
    import time

    tokenizer = token_counts._tokenizer(token_counts.tokenizer_path())
    text = "ab" * 500_000 + " and a tail " * 3000
    began = time.perf_counter()
    want = tokenizer.encode(text, add_special_tokens=False).ids
    middle = time.perf_counter()
    assert [i for part in token_counts.spliced(tokenizer, text) for i in part] == want
    assert time.perf_counter() - middle < 20 * (middle - began) + 2


def test_token_counts(plain, odd, empty):
    tokenizer = token_counts._tokenizer(token_counts.tokenizer_path())
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(plain, huge=1000, chunk=512, overlap=64).collect()}
    assert got == {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS)}
    assert token_counts.token_counts(odd).count() == odd.count() and token_counts.token_counts(empty).count() == 0


# --- op7 ---------------------------------------------------------------------


def test_perplexity_by_brute_force(spark, real):
    """Twenty texts, with the model in one shard, in several, and with languages in parts."""
    rows = real.where("n_chars between 100 and 4000").orderBy("doc_id").limit(24).select("doc_id", "lang", "text").collect()
    train, asked = rows[:12], rows[4:] + [(900, None, "no model here"), (901, "xx", "none either"), (902, rows[0].lang, None), (903, rows[0].lang, " \n"), (904, rows[0].lang, "漢字"), (904, rows[0].lang, "漢字")]
    docs = spark.createDataFrame([tuple(r) for r in asked], "doc_id long, lang string, text string")
    model = perplexity.Model(spark.createDataFrame([tuple(r) for r in train], "doc_id long, lang string, text string"))
    models = {x: brute.kneser_ney([r.text for r in train if r.lang == x]) for x in {r.lang for r in train}}
    want = sorted((d, models[x](t) if x in models else None) for d, x, t in map(tuple, asked))
    most = model.grams.count() + model.contexts.count()
    for rows_in_shard in (1 << 21, most // 7):
        got = sorted((r.doc_id, r.perplexity) for r in perplexity.perplexities(docs, model, rows_in_shard).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(g[1] == (pytest.approx(w[1]) if w[1] is not None else None) for g, w in zip(got, want, strict=True))
    assert len(perplexity._shards(model, most // 7)) > 7


def test_perplexity_sums_to_one(spark):
    """The probabilities of what may follow a known context add up to one, an unseen character included."""
    docs = spark.createDataFrame([(1, "en", "abab abc abd bca"), (2, "en", "cab bab ab ab")], "doc_id long, lang string, text string")
    model = perplexity.Model(docs)
    grams, contexts = (perplexity.Lookup(*perplexity._pairs(df, k, ["en"])) for df, k in ((model.grams, "g"), (model.contexts, "x")))
    alphabet = [ord(c) for c in "abcd \2"] + [ord("z")]
    salt = perplexity._salt("en")
    for context in ("\1\1\1", "aba", "b a", "zza"):
        total = 0.0
        for c in alphabet:
            points = np.array([*map(ord, context), c], dtype=np.uint64)
            use = np.array([False, False, False, True])
            total += float(np.exp(perplexity._log_probabilities(points, np.full(4, salt), use, grams, contexts))[0])
        assert total == pytest.approx(1.0)


def test_perplexity_edges(spark, plain, odd, empty):
    labels = spark.createDataFrame([(6, 1, 0), (8, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in perplexity.classify(plain, labels).collect()}
    assert len(got) == len(TEXTS) and not got[0].kept and not got[1].kept and got[6].kept and got[7].kept
    assert perplexity.classify(odd, labels).count() == odd.count()
    assert perplexity.classify(empty, labels).count() == 0


def test_perplexity_thresholds_are_those_of_unseen_texts(spark, real):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = perplexity.classify(real, labels).collect()
    trusted = {r.doc_id for r in perplexity.trusted_ids(labels).collect()}
    for lang in {r.lang for r in rows}:
        every = [(r.doc_id, r.perplexity) for r in rows if r.lang == lang and r.doc_id in trusted and r.perplexity]
        unseen = [p for d, p in every if zlib.crc32(str(d).encode()) % 5 == 0]
        quantile = lambda x: sorted(x)[int(np.ceil(perplexity.LEVEL * len(x))) - 1]
        (bound,) = {r.threshold for r in rows if r.lang == lang}
        assert bound == pytest.approx(perplexity.MARGIN * max(quantile(x) for x in (unseen, [p for _, p in every]) if x))


def test_perplexity_separates(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = perplexity.op7_perplexity(spark, d).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


# --- op8 ---------------------------------------------------------------------


@pytest.mark.parametrize("length,base", [(20, 10), (20, 5), (7, 2), (3, 3)])
def test_substrings(plain, length, base):
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in substring_dedup.deduplicate_substrings(plain, length, base).collect()}
    assert got == brute.substrings(sorted(_pairs(plain)), length)


def test_substrings_real(spark, real):
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.op8_substring_dedup(spark, DATA).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == brute.substrings(sorted(_pairs(real)))


def test_substrings_odd_and_empty(odd, empty):
    got = substring_dedup.deduplicate_substrings(odd).collect()
    assert len(got) == odd.count()
    firsts = [r for r in got if r.n_words >= 60 and r.n_removed == 0]
    assert {r.doc_id for r in firsts} == {1}
    assert substring_dedup.deduplicate_substrings(empty).count() == 0


# --- op9 ---------------------------------------------------------------------


def test_quality_counts(plain, real):
    for docs in (plain, real):
        got = quality_rules.judge(docs).collect()
        texts = dict(_pairs(docs))
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[r.doc_id]), r.doc_id
            assert not (r.kept and r.base_failed)


def test_quality_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.25, 0.75], [0.75, 0.25])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality_rules.jensen_shannon("p", "q")).collect()]

    def js(p, q):
        h = lambda x: -sum(v * np.log2(v) for v in x if v)
        return np.sqrt(h([(a + b) / 2 for a, b in zip(p, q, strict=True)]) - (h(p) + h(q)) / 2)

    assert got == pytest.approx([0.0, 1.0, js([0.25, 0.75], [0.75, 0.25])])


def test_quality_odd_and_empty(odd, empty):
    assert quality_rules.judge(odd).count() == odd.count()
    assert quality_rules.judge(empty).count() == 0


# --- texts longer than a slice -----------------------------------------------


def test_long_texts(spark):
    """Texts of more than the 2 MB that are handled at once, beside short ones: op7, op8, op9."""
    long = " ".join(f"{i:x}".ljust(40, "q") for i in range(60_000))
    texts = [long, "a b c", long.replace(f"{777:x}".ljust(40, "q"), "other"), PASSAGE, None]
    docs = _docs(spark, range(len(texts)), texts)
    assert len(long) > 2 << 20
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in substring_dedup.deduplicate_substrings(docs).collect()}
    assert got == brute.substrings(_pairs(docs))
    for r in quality_rules.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[r.doc_id])
    model = perplexity.Model(docs.where("doc_id in (1, 3)"))
    plain = brute.kneser_ney([texts[1], texts[3]])
    for r in perplexity.perplexities(docs, model).collect():
        want = plain(texts[r.doc_id])
        assert r.perplexity == (None if want is None else pytest.approx(want))


# --- op10 --------------------------------------------------------------------


def _mix_key(d, t, s):
    return d is None, d or 0, len(brute.SPACED.findall(t or "")), s or ""


@pytest.mark.parametrize("seed,total", [("mix-2", 1.5), ("other", 0.4)])
def test_mix(spark, real, seed, total):
    rows = real.select("doc_id", "text", "source").collect()
    got = {r.doc_id: r for r in mixture.mix(real, seed=seed, total=total).collect()}
    want = brute.mix([tuple(r) for r in rows], seed=seed, total=total)
    assert {r.doc_id: want[i] for i, r in enumerate(rows)} == {k: v.copies for k, v in got.items()}
    assert all(r.taken == r.copies * r.size <= 2 * r.size for r in got.values())


def test_mix_odd_and_empty(odd, empty, plain):
    for docs in (odd, plain):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        want = brute.mix(rows)
        assert sorted((_mix_key(*r), want[i]) for i, r in enumerate(rows)) == sorted(((r.doc_id is None, r.doc_id or 0, r.size, r.source or ""), r.copies) for r in mixture.mix(docs).collect())
        out = mixture.mixed(docs)
        assert out.columns == docs.columns
        assert Counter(_mix_key(r.doc_id, r.text, r.source) for r in out.collect()) == Counter(k for i, r in enumerate(rows) for k in [_mix_key(*r)] * want[i])
    assert mixture.mix(empty).count() == 0 and mixture.mixed(empty).count() == 0


def test_mix_repeated_rows(spark, monkeypatch):
    """Equal rows without ids are taken one by one, also where they are many; columns may hold dots."""
    monkeypatch.setattr(mixture, "_MANY", 16)
    docs = _docs(spark, [None] * 100, ["a b c d e f g h i j"] * 100).withColumn("a.b", F.lit("x"))
    got = mixture.mix(docs, total=0.5).collect()
    assert len(got) == 100 and sum(r.taken for r in got) == 500
    out = mixture.mixed(docs, total=0.5)
    assert out.columns == docs.columns and out.count() == 50
    assert mixture.mixed(docs, total=1.73).count() == 173
    sizes = [1 + i % 7 for i in range(100)]
    some = _docs(spark, [None] * 100, [" ".join("x" * n) for n in sizes])
    assert abs(sum(r.taken for r in mixture.mix(some, total=1.5).collect()) - 1.5 * sum(sizes)) <= 1


def test_mix_weights(spark):
    docs = _docs(spark, range(300), ["a b c d"] * 300).withColumn("w", F.when(F.col("doc_id") < 150, 9.0).otherwise(1.0))
    got = {r.doc_id: r.copies for r in mixture.mix(docs, total=0.5, weight_col="w").collect()}
    want = brute.mix([(i, "a b c d", "s") for i in range(300)], weight=lambda i, _: 9_000_000 if i < 150 else 1_000_000, total=0.5)
    assert got == want and sum(got.values()) == 150 and sum(got[i] for i in range(150)) > 120


def test_mix_inclusion_frequencies():
    """Over many seeds documents are included as often as their probabilities say; the plain version is what Spark gives, see above."""
    kinds = [1, 2, 3, 4, 6, 9, 12, 16, 20, 25, 30, 36, 49, 600]
    docs = [(i, " ".join("x" * n), "s") for i, n in enumerate(kinds * 6)]
    size = [len(t.split()) for _, t, _ in docs]
    for total in (0.3, 0.8):
        weight = [int(n**0.5 * 1024) for n in size]
        certain: set = set()
        while True:
            level = (total * sum(size) - sum(size[i] for i in certain)) / sum(size[i] * weight[i] for i in range(len(docs)) if i not in certain)
            if not (more := {i for i in range(len(docs)) if level * weight[i] >= 1} - certain):
                break
            certain |= more
        p = np.array([min(1.0, level * w) for w in weight])
        assert p @ size == pytest.approx(total * sum(size)) and len(certain) == (6 if total == 0.8 else 0)
        seen = np.zeros(len(docs))
        for k in range(30):
            seen += [brute.mix(docs, seed=f"s{k}", total=total)[i] for i in range(len(docs))]
        assert np.abs((seen / 30 - p).reshape(6, -1).mean(axis=0)).max() < 0.12
        assert all(seen[i] == 30 for i in certain)
