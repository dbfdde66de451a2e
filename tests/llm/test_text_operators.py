"""Each operator against brute force on small fixtures, odd rows included."""

from __future__ import annotations

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lorewright.llm import bpe, chunks, components, decontaminate, quality, runtime, sharding, simhash, sstable, substring, textops, wide_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made_texts(seed: int, n: int = 60) -> list[str | None]:
    """Texts with copies, shared passages, empty, null and one-word ones, odd white space."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "naïve", "C++", "don't", "漢字", "a_b", "x.", "\x1c", "é"]
    passage = [pick.choice(words) for _ in range(30)]
    out: list[str | None] = [None, "", "   \n\t", "one", " ".join(passage), " ".join(passage)]
    while len(out) < n:
        body = [pick.choice(words) for _ in range(pick.randint(1, 120))]
        if pick.random() < 0.4:
            at = pick.randint(0, len(body))
            body[at:at] = passage[pick.randint(0, 5) : pick.randint(15, 30)]
        text = pick.choice([" ", "\n", "\x0b", " \t "]).join(body)
        out.append(text)
        if pick.random() < 0.2:
            out.append(text)
        if pick.random() < 0.2:
            changed = list(body)
            changed[pick.randrange(len(changed))] = "changed"
            out.append(" ".join(changed))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = made_texts(1)
    rows = [(7 * i % 1009, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- substring dedup


def removed(rows, width=13):
    first: dict = {}
    for d, t in rows:
        w = spaced(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = spaced(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("width", [13, 3])
def test_substring_dedup(docs, width):
    got = substring.remove_repeats(docs.withColumn("n_words", F.lit("clash")).withColumn("kind", F.lit(1)), width)
    assert set(docs.columns) | {"kind"} <= set(got.columns)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()) == sorted(removed(rows_of(docs), width))


def test_substring_dedup_ties_and_nulls(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(400))
    rows = [(5, a), (5, a), (5, b), (3, b), (None, a), (None, b), (9, a + " " + b), (9, None), (2, ""), (8, " ".join(["z"] * 300)), (9, " ".join(["z"] * 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(df).collect()]
    key = lambda r: (r[0] is not None, r)
    assert sorted(got, key=key) == sorted(removed(rows), key=key)


def test_substring_layout_kept(spark):
    shared = " ".join(f"p{i}" for i in range(15))
    df = spark.createDataFrame([(1, shared), (2, f"My  own\nlines {shared}\nand  more"), (3, "un\n touched ")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(df, keep_layout=True).collect()}
    assert got == {1: shared, 2: "My  own\nlines and  more", 3: "un\n touched "}


@pytest.mark.parametrize("remembered", [1 << 20, 3])
def test_substring_common_parts(spark, monkeypatch, remembered):
    """Nine words amid others that all differ: their windows are dealt by their own hashes."""
    monkeypatch.setattr(substring, "HOT_WINDOWS", 100)
    monkeypatch.setattr(substring, "REMEMBERED", remembered)
    pick = random.Random(3)
    common = [f"c{i}" for i in range(9)]
    rows = []
    for i in range(300):
        own = [f"w{pick.randrange(10**6)}" for _ in range(60)]
        rows.append((pick.randrange(1000), " ".join([*own[:30], *common, *own[30:]])))
    rows += [(2000 + i, rows[i % 7][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot = substring._common_parts(df, "text", 13, 1)
    assert 1 <= len(hot) <= 9
    dealt = collections.Counter()
    words, row, _ = substring._words(*textops.utf8(pa.array([t for _, t in rows])))
    least = substring._least_parts(words, 13)
    inside = row[: len(least)] == row[12:]
    dealt.update((substring._dest(np.where(np.isin(least, hot), textops.window_hashes(words, 13), least), 408)[inside]).tolist())
    plain = collections.Counter(substring._dest(least, 408)[inside].tolist())
    assert max(dealt.values()) < 0.3 * max(plain.values())
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(df).collect()]
    assert sorted(got) == sorted(removed(rows))


def test_substring_hashes_that_collide(spark):
    """Equal 64 bits are not enough: the other bits keep windows apart."""
    doc, hashes, check = np.array([2, 1, 3, 1]), np.array([5, 5, 5, 5], np.uint64), np.array([7, 8, 7, 8], np.uint64)
    assert substring._first_only(doc, hashes, check).tolist() == [True, True, False, True]


def test_substring_key_type(spark):
    with pytest.raises(TypeError):
        substring.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_substring_long_text(spark):
    pick = random.Random(4)
    body = [f"w{pick.randrange(400)}" for _ in range(200_000)]
    rows = [(1, " ".join(body[:50_000])), (2, " ".join(body)), (3, "x" * 3_000_000), (4, " ".join(body[40_000:60_000]))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (n, r) for d, n, r, _ in removed(rows)}


def test_substring_empty(no_docs):
    assert substring.remove_repeats(no_docs).count() == 0


# --- decontamination


def contamination(rows, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    known: dict = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if of := known.get(tuple(w[k : k + n])):
                    found |= of
                    hit[k : k + n] = [True] * n
        out.append((d, len(w), sum(hit), sorted(map(str, found)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


@pytest.mark.parametrize("item_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, item_bytes):
    texts = [t for _, t in rows_of(docs) if t and len(t) > 80]
    items = [(1, texts[0]), (2, texts[1][:120]), (10, texts[1]), (3, "w1 w2"), (4, None), (5, " -- "), (6, "one"), (6, "ONE"), (7, "ÜBER naïve über")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs.withColumn("items", F.lit(0)).withColumn("__items", F.lit("own")).withColumn("body", F.lit(1)), benchmark, item_bytes=item_bytes)
    assert {r["__items"] for r in got.collect()} == {"own"}
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()) == sorted(contamination(rows_of(docs), items))
    for r in got.where("n_hit > 0").limit(5).collect():
        a, b = decontaminate.original_span(r["text"], r["hit_from"][0], r["hit_to"][0] - 1)
        assert decontaminate.normal_words(r["text"][a:b].encode()) == decontaminate.normal_words(r["text"].encode())[r["hit_from"][0] : r["hit_to"][0]]


@pytest.mark.parametrize("width", [13, 4, 1])
@pytest.mark.parametrize("item_bytes", [1 << 20, 400])
def test_decontamination_at_random(spark, width, item_bytes):
    """Items and texts of few words, so that windows overlap, repeat and nearly match."""
    pick = random.Random(width)
    word = lambda: pick.choice("ab") if pick.random() < 0.9 else pick.choice(["c", "É", "9"])
    items = [(i, " ".join(word() for _ in range(pick.choice([0, 1, 2, 6, 7, 8, 12, 13, 14, 20, 40])))) for i in range(30)] + [(30, "a " * 200)]
    rows = [(i, "-".join(word() for _ in range(pick.randint(0, 120)))) for i in range(60)] + [(60, "a " * 3000), (61, None), (62, "x y"), (62, "x y")]
    rows += [(70 + i, f"zz {items[i][1].upper()} zz") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), width, item_bytes=item_bytes)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()) == sorted(contamination(rows, items, width))


def test_decontamination_automaton_is_small():
    pick = random.Random(1)
    items = [(i, " ".join(f"w{pick.randrange(5000)}" for _ in range(100))) for i in range(300)]
    matcher = decontaminate.Matcher(items, 13)
    assert matcher.automaton.get_stats()["nodes_count"] <= 30_001


def test_decontamination_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.find_contamination(no_docs, none).count() == 0


@pytest.mark.parametrize("item_bytes", [1 << 20, 150])
def test_decontamination_null_ids(spark, item_bytes):
    """Items without an id hit, and are not named."""
    body = [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(5)]
    benchmark = spark.createDataFrame([(None, body[0]), (7, body[1]), (None, body[2]), (8, None)], "item_id long, text string")
    texts = [body[0], body[1], f"{body[2]} {body[1]}", body[3]]
    got = decontaminate.find_contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark, item_bytes=item_bytes)
    assert sorted((r["doc_id"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()) == [(0, 20, [], True), (1, 20, ["7"], True), (2, 40, ["7"], True), (3, 0, [], False)]


# --- SimHash


def brute_components(rows, words_each=3, bits=3):
    fps = []
    for _, t in rows:
        w = spaced((t or "").translate(LOWER))
        grams = [" ".join(w[i : i + words_each]) for i in range(len(w) - words_each + 1)] or ([" ".join(w)] if w else [])
        counts = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g, seed=42)
            for b in range(64):
                counts[b] += h >> b & 1
        fps.append(sum(1 << b for b in range(64) if 2 * counts[b] > len(grams)))
    return [f"{f:016x}" for f in fps], linked(fps, [d for d, _ in rows], bits)


def linked(fps, ids, bits):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                up[root(i)] = root(j)
    least: dict = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def test_simhash(spark, docs):
    extra = spark.createDataFrame([(None, "lone null key", "", "", 0), (None, "one", "", "", 0), (4, "one", "", "", 0)], SCHEMA)
    df = docs.unionByName(extra)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    fps, least = brute_components(rows)
    got = simhash.near_duplicates(df)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=key) == sorted(zip([d for d, _ in rows], fps, least, strict=True), key=key)
    stay = simhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(brute_components(rows_of(docs))[1]))


@pytest.mark.parametrize("bits", range(6))
@pytest.mark.parametrize("block", [2048, 5])
def test_simhash_links_dense_fingerprints(spark, monkeypatch, bits, block):
    """Clusters with many members a key, through both the plain and the blocked way."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    pick = random.Random(bits)
    fps = set()
    for _ in range(6):
        centre = pick.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(pick.randint(0, 2 + bits)):
                f ^= 1 << pick.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = simhash.link_fingerprints(df, bits)
    roots = {r["node"]: r["root"] for r in components.connected(found, "a", "b").collect()}
    mine = [roots.get(int(np.uint64(f).view(np.int64)), int(np.uint64(f).view(np.int64))) for f in fps]
    want = linked(fps, list(range(len(fps))), bits)
    assert len(set(mine)) == len(set(want)) == len(set(zip(mine, want, strict=True)))


def test_simhash_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def test_components_of_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components.connected(links, "a", "b").collect()} == {0}


# --- fingerprints


def test_chunks(spark, docs):
    rows = rows_of(docs.where("doc_id is not null"))
    got = {r["doc_id"]: r for r in chunks.edited_and_next(docs).collect()}
    assert len(got) == len(rows)
    by_text: dict = {}
    for k, (d, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)]
        q = len(t) // 4
        r = got[d]
        assert r["edited_text"] == t[: len(t) - q] + (after[1] or "")[:q] and r["n_chars"] == len(t)
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == pytest.approx(chunks.containment(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(chunks.containment(r["fingerprint"], got[after[0]]["fingerprint"]))


def test_chunks_shift(spark):
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    df = spark.createDataFrame([(1, base), (2, "a new start. " + base), (3, "other " * 50)], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in chunks.fingerprints(df).collect()}
    assert chunks.containment(got[1], got[2]) > 0.9 and chunks.containment(got[1], got[3]) < 0.1


def test_chunks_odd(spark, no_docs):
    df = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert chunks.edited_and_next(df).first()["edited_text"] == "alonea"[:4] + "a"
    ties = spark.createDataFrame([(1, "bbbb"), (1, "aaaa"), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(r["edited_text"] for r in chunks.edited_and_next(ties).collect()) == ["", "", "aaab", "bbb"]
    assert chunks.edited_and_next(no_docs).count() == 0 and chunks.fingerprints(no_docs).count() == 0


def test_chunks_hot_keys(spark):
    """A key, and null, of a third of all rows each: order by hash of the text, over several ranges."""
    pick = random.Random(11)
    rows = [(None if i % 3 == 0 else 50 if i % 3 == 1 else pick.randrange(100), f"{i} " * pick.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("mixed", F.lit(1)).repartition(5)
    mixed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mixed[r[1]], r[1]))
    want = sorted((str(d), t[: len(t) - len(t) // 4] + ordered[(k + 1) % len(rows)][1][: len(t) // 4]) for k, (d, t) in enumerate(ordered))
    assert sorted((str(r["doc_id"]), r["edited_text"]) for r in chunks.edited_and_next(df).collect()) == want
    with pytest.raises(TypeError):
        chunks.edited_and_next(df.withColumn("doc_id", F.lit("a")))


def test_range_part(spark):
    """Binary search of the cuts, in the JVM and in workers."""
    cuts = [3, 7, 7, 7, 10, 20, 20]
    keys = [-5, 3, 4, 7, 8, 10, 15, 20, 99]
    df = spark.createDataFrame([(k, h) for k in keys for h in (-(2**63), -1, 0, 2**63 - 1)], "k long, h long")
    got = collections.defaultdict(list)
    for r in df.select("k", runtime.range_part(F.col("k"), F.col("h"), cuts).alias("p")).collect():
        got[r["k"]].append(r["p"])
    assert {k: v for k, v in got.items() if k not in (7, 20)} == {k: [sum(c <= k for c in cuts)] * 4 for k in keys if k not in (7, 20)}
    assert got[7] == [2, 3, 3, 4] and got[20] == [6, 6, 7, 7]
    part, share = runtime.range_parts(pa.array([*keys, None]), cuts, [bytes([i]) for i in range(10)])
    assert part[0] == part[9] == 0 and part[1] == 1 and 2 <= part[3] <= 4 and share[3] == part[3] - 2 and 6 <= part[7] <= 7
    assert spark.range(3).select(runtime.range_part(F.col("id"), F.col("id"), []).alias("p")).distinct().collect()[0][0] == 0


# --- token ids


class TestTokens:
    ODD = ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "it's I'D 's ''s don't", "İ ǅ ﬁ ｗ Σας", "a   b\n\n c  \n", "\x85 \xa0x", "²³ 12½", "x" * 3000, "😀 नमस्ते", "!!!???", "<|nothing|>"]

    def both(self, spark, docs):
        rows = [(2000 + i, t, "", "", 0) for i, t in enumerate(self.ODD)] + [(None, "null key", "", "", 0), (2000, "same key", "", "", 0)]
        return docs.unionByName(spark.createDataFrame(rows, SCHEMA))

    def test_prefix_bpe(self, spark, docs, no_docs):
        from tokenizers import Tokenizer

        path = public_tokenizers.path("word_bpe_49k.json")
        library = Tokenizer.from_file(path)
        for r in bpe.encode_texts(self.both(spark, docs).withColumn("ids", F.lit(1)), path).collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
            assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert bpe.encode_texts(no_docs, path).count() == 0

    def test_tables(self, spark, docs, no_docs, tmp_path):
        from tokenizers import Tokenizer

        path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/tables"
        library = Tokenizer.from_file(path)
        df = self.both(spark, docs)
        want = sorted(((-1 if r["doc_id"] is None else r["doc_id"], np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u2").tobytes()) for r in df.collect()))
        manifest = sstable.write_tables(df, path, 2, folder)
        start, expected = 0, []
        for d, ids in want:
            expected.append((d, start, len(ids) // 2, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())))
            start += len(ids) // 2
        got = [(-1 if r["key"] is None else r["key"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in sstable.read_tables(manifest).collect()]
        assert sorted(got) == expected
        for r in manifest.collect():
            table = sstable.Reader.at(r["file"])
            assert table.get(sstable.key_id(bytes(r["first_key"])))[-1] == 2 and table.get(-5) is None
        assert sum(sstable.Reader.at(r["file"]).may_have(sstable.key_bytes(10**9 + i)) for r in manifest.collect() for i in range(100)) < 0.1 * 100 * manifest.count()
        empty = sstable.write_tables(no_docs, path, 2, f"{folder}-none")
        assert sstable.read_tables(empty).count() == 0


def test_tables_of_many_files_and_hot_keys(spark, tmp_path, monkeypatch):
    """Several files a part; a key of a third of all rows and null keys are dealt to several parts."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pick = random.Random(6)
    rows = [(pick.randrange(500) if i % 3 else 77, " ".join(f"w{pick.randrange(50)}" for _ in range(pick.randint(0, 30)))) for i in range(600)]
    rows += [(None, f"null {i}") for i in range(200)] + [(-(2**63), "least"), (2**63 - 1, "most"), (900, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).repartition(5)
    monkeypatch.setattr(sstable, "FILE_BYTES", 1000)
    monkeypatch.setenv("PYTHONHASHSEED", "0")
    manifest = sstable.write_tables(df, path, 2, f"file://{tmp_path}/tables", groups=9)
    files = manifest.orderBy("part", "nth").collect()
    assert len({r["part"] for r in files}) > 6 and [r["ids_before"] for r in files] == np.cumsum([0, *(r["ids"] for r in files)])[:-1].tolist()
    assert [bytes(r["first_key"]) for r in files] == sorted(bytes(r["first_key"]) for r in files)
    got = sorted(sstable.read_tables(manifest).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    least = lambda d: (d is not None, d or 0)
    assert [least(r["key"]) for r in got] == sorted(least(d) for d, _ in rows)
    want = sorted((least(d), library.encode(t, add_special_tokens=False).ids + [2]) for d, t in rows)
    assert sorted((least(r["key"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    hot = [r["part"] for r in files if sstable.key_id(bytes(r["first_key"])) == 77]
    assert len(set(hot)) > 1
    asked = spark.createDataFrame([(900,), (77,), (None,), (12345,), (-5,), (900,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in sstable.find_documents(asked, manifest).collect()}
    assert np.frombuffer(found[900], "<u4").tolist() == library.encode("long " * 100_000, add_special_tokens=False).ids + [2]
    assert found[12345] is None and found[-5] is None and found[77] is not None and found[None] is not None
    with pytest.raises(TypeError):
        sstable.write_tables(df.withColumn("doc_id", F.lit("x")), path, 2, f"file://{tmp_path}/none")


def test_pieces_whose_hashes_collide(monkeypatch):
    """A hash that two pieces share does not give one the other's ids."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    hashes = textops.span_hashes
    monkeypatch.setattr(textops, "span_hashes", lambda raw, a, b: hashes(raw, a, b) % np.uint64(50))
    with open(path, encoding="utf-8") as f:
        coder = sstable.Encoder(f.read())
    pick = random.Random(1)
    texts = [" ".join(f"word{pick.randrange(1000)}" for _ in range(pick.randint(1, 5))) for _ in range(40)]
    for t in texts:
        assert np.frombuffer(coder.encode([t.encode()])[0], coder.kind).tolist() == library.encode(t, add_special_tokens=False).ids


def test_table_lookup():
    sink = io.BytesIO()
    writer = sstable.Writer(sink, 2)
    keys = [*range(-3000, 3000, 3)]
    for k in keys:
        writer.add(sstable.key_bytes(k), np.array([k & 0xFFFF] * (1 + k % 50), "<u2").tobytes())
    writer.finish()
    table = sstable.Reader.of(sink.getvalue())
    assert len(table.index) > 1 and [sstable.key_id(k) for k, _ in table.scan()] == keys
    for k in range(-3010, 3010):
        assert table.get(k) == ([k & 0xFFFF] * (1 + k % 50) if k in range(-3000, 3000, 3) else None)


# --- sharding


def jump(key: int, buckets: int) -> int:
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[random.Random(3).randrange(-(2**63), 2**63) for _ in range(300)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 41, 97):
        assert [r[1] for r in df.select("k", sharding.jump_hash(F.col("k"), n)).collect()] == [jump(k % (1 << 64), n) for k in keys]


def test_shards(spark, docs, no_docs):
    df = docs.select("doc_id").unionByName(spark.createDataFrame([(None,), (5,), (5,)], "doc_id long")).unionByName(spark.range(3000, 5000).select(F.col("id").alias("doc_id")))
    got = sharding.assign_shards(df.withColumn("slot", F.lit("clash")), "doc_id", 40, groups=3).collect()
    assert len(got) == df.count()
    for s in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    moved = sum(r["grown_shard"] == 40 for r in got) / len(got)
    assert 0.01 < moved < 0.05
    assert sharding.assign_shards(no_docs, "doc_id", 40).count() == 0


def test_shards_of_other_keys_and_names(spark):
    """String keys, columns named like the inner ones, a hot key, repeated rows, many shards."""
    rows = [("hot" if i % 3 else f"k{i}", i % 50, f"t{i % 70}") for i in range(600)] + [(None, 1, None), ("hot", 1, "t1"), ("hot", 1, "t1")]
    df = spark.createDataFrame(rows, "id string, rank long, part string").withColumn("before", F.lit("b")).withColumn("r", F.lit(1)).withColumn("h", F.lit(2)).withColumn("row", F.lit(3)).withColumn("__part", F.lit(4)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = sharding.assign_shards(df, "id", 7, groups=5)
    assert got.columns == [*df.columns, "shard", "grown_shard", "slot"]
    once, twice = ([(r["id"] or "", r["rank"], r["part"] or "", r["shard"], r["slot"]) for r in x.collect()] for x in (got, sharding.assign_shards(df.repartition(3), "id", 7, groups=5)))
    assert sorted(once) == sorted(twice) and len({s for i, _, _, s, _ in once if i == "hot"}) == 1
    for shard in range(7):
        slots = sorted(x[4] for x in once if x[3] == shard)
        assert slots == list(range(len(slots)))
    many = sharding.assign_shards(spark.range(200), "id", 100_000).collect()
    hashes = {r["id"]: r["h"] for r in spark.range(200).select("id", F.xxhash64("id").alias("h")).collect()}
    assert all(r["shard"] == jump(hashes[r["id"]] % (1 << 64), 100_000) for r in many)
    with pytest.raises(ValueError):
        sharding.assign_shards(df.withColumn("slot", F.lit(1)), "slot", 7)


def test_jump_hash_of_many_jumps(spark, monkeypatch):
    """A key that needs more than the usual number of jumps takes them all."""
    keys = [random.Random(9).randrange(-(2**63), 2**63) for _ in range(400)]

    class Short(int):
        def bit_length(self):
            return -3

    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert [r[0] for r in df.select(sharding.jump_hash(F.col("k"), Short(500))).collect()] == [jump(k % (1 << 64), 500) for k in keys]


# --- quality


def test_quality(spark):
    pick = random.Random(5)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels, truth = [], [], {}
    for d in range(900):
        body = [pick.choice(words) for _ in range(pick.randint(20, 80))]
        kind = d % 6
        if kind == 0:
            for _ in range(3):
                body[pick.randrange(len(body))] = pick.choice(["vilest", "vermin"])
        if kind == 1:
            body = [w.upper() + "!!" for w in body]
        truth[d] = kind > 1
        rows.append((d, " ".join(body), "en", f"s{d % 7}" if d % 5 else "lone%d" % d, 0))
        if d % 2 == 0 or d < 300:
            labels.append((d, int(kind != 1), int(kind == 0)))
    rows += [(1000, None, None, None, 0), (1001, "", "en", None, 0), (None, "wortaa wortba", "en", "s1", 0)]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    assert len(got) == len(rows)
    wrong = [d for d in truth if got[d]["keep"] != truth[d]]
    assert len(wrong) < 0.02 * len(truth)
    assert all(0 <= r["site_rate"] <= 1 for r in got.values())
    kept = quality.reject_bad(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in got.values())
    # A sparse site stays near the whole; the spread of sites is small here.
    rates = [r["site_rate"] for r in got.values()]
    assert max(rates) - min(rates) < 0.25
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.reject_bad(docs, none).count() == len(rows)
    assert quality.classify(docs.limit(0), known).count() == 0


def test_quality_by_formula(spark):
    """Rates and posterior of every row, computed again from the evidence."""
    pick = random.Random(8)
    rows, labels = [], []
    for d in range(700):
        bad = pick.random() < 0.3
        body = [pick.choice("alpha beta gamma delta rho".split()) for _ in range(40)] + ["vilest"] * (bad and pick.random() < 0.8)
        rows.append((d, " ".join(body), pick.choice(["en", "fr"]) if d % 9 else None, f"s{int(pick.random() ** 3 * 12)}" if d % 11 else None, 0))
        if d % 2:
            labels.append((d, int(not bad), 0))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("evidence", F.lit("clash")).withColumn("n", F.lit(0)).withColumn("site_host", F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    model = quality.train(docs, known)
    logit = lambda p: np.log(p / (1 - p))
    groups: dict = collections.defaultdict(list)
    for d, _, lang, source, _ in rows:
        groups[source, lang].append(1 / (1 + np.exp(-np.clip(got[d]["evidence"] + logit(model.base), -30, 30))))

    def strength(parts):
        """Of (n, share, toward) of each group: pseudo-rows by moments."""
        between = sum(n * (x - m) ** 2 for n, x, m in parts)
        within, scale = sum(m * (1 - m) for _, _, m in parts), sum(n * m * (1 - m) for n, _, m in parts)
        return min(1000, max(2, 1 / max(1e-6, (between - within) / scale) - 1))

    prior = np.mean([p for g in groups.values() for p in g])
    hosts: dict = collections.defaultdict(list)
    for (host, _), g in groups.items():
        hosts[host] += g
    k = strength([(len(g), np.mean(g), prior) for g in hosts.values()])
    host_rate = {h: (sum(g) + k * prior) / (len(g) + k) for h, g in hosts.items()}
    k = strength([(len(g), np.mean(g), host_rate[h]) for (h, _), g in groups.items()])
    for d, _, lang, source, _ in rows:
        own, g = 1 / (1 + np.exp(-np.clip(got[d]["evidence"] + logit(model.base), -30, 30))), groups[source, lang]
        site_rate = (sum(g) - own + k * host_rate[source]) / (len(g) - 1 + k)
        assert got[d]["host_rate"] == pytest.approx(host_rate[source], rel=1e-6) and got[d]["site_rate"] == pytest.approx(site_rate, rel=1e-6, abs=1e-9)
        p = 1 / (1 + np.exp(-(got[d]["evidence"] + logit(np.clip(site_rate, 0.001, 0.999)))))
        assert got[d]["p_bad"] == pytest.approx(p, rel=1e-6) and got[d]["keep"] == (p <= quality.THRESHOLD)


def test_quality_site_decides(spark):
    """The same doubtful text goes on a bad host and stays on a good one; a sparse site says little."""
    pick = random.Random(9)
    rows, labels = [], []
    for d in range(1200):
        host = "bad" if d % 2 else "good"
        bad = pick.random() < (0.9 if host == "bad" else 0.05)
        words = [pick.choice("alpha beta gamma delta rho".split()) for _ in range(30)]
        rows.append((d, " ".join(words + ["vilest"] * (3 * bad)), "en", host, 0))
        labels.append((d, int(not bad), 0))
    doubtful = "alpha beta gamma delta rho " * 6 + "vilest"
    rows += [(5000, doubtful, "en", "bad", 0), (5001, doubtful, "en", "good", 0), (5002, doubtful, "en", "lone", 0)]
    got = {r["doc_id"]: r for r in quality.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[5000]["evidence"] == got[5001]["evidence"] == got[5002]["evidence"]
    assert got[5000]["site_rate"] > 0.7 > 0.2 > got[5001]["site_rate"] and got[5001]["p_bad"] < got[5002]["p_bad"] < got[5000]["p_bad"]
    prior = np.mean([r["host_rate"] for r in got.values()])
    assert abs(got[5002]["site_rate"] - prior) < 0.5 * abs(got[5000]["site_rate"] - prior) + 0.2


def test_quality_odd_labels(spark):
    """Null labels are not used, repeated keys and labels count once, long texts pass."""
    rows = [(d, ("vilest " if d % 3 == 0 else "fine ") * 20 + f"w{d}", "en", "s", 0) for d in range(300)]
    labels = [(d, int(d % 3 != 0), None if d % 3 == 0 else 0) for d in range(300)] + [(301, None, None), (1, None, 0), (None, 0, 1)] + [(d, int(d % 3 != 0), 0) for d in range(2, 300)]
    many = rows + [(0, rows[0][1], "en", "s", 0)] * 50 + [(400, "vilest " * 200_000, "en", "s", 0), (401, " ".join(f"u{i}" for i in range(100_000)), "en", "s", 0)]
    known = spark.createDataFrame([*labels, (401, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(many, SCHEMA)
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, known).collect()}
    assert all(got[d] == (d % 3 != 0) for d in range(300)) and not got[400]
    only_open = spark.createDataFrame([(d, None, 0) for d in range(300)], "doc_id long, quality int, toxic int")
    assert quality.train(docs, only_open) is None


# --- very long texts and clashing names


def test_long_texts(spark):
    """A text of some MB goes through every operator that reads texts."""
    long = " ".join(f"w{i * 7919 % 5000}" for i in range(300_000))
    rows = [(1, long), (2, long), (3, "short text here"), (4, "x" * 2_000_000), (5, long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got[1] == got[2] and got[1][1] == 1 and got[3][1] == 3
    prints = {r["doc_id"]: r["fingerprint"] for r in chunks.fingerprints(df).collect()}
    assert prints[1] == prints[2] and chunks.containment(prints[5], prints[1]) > 0.99
    assert {r["doc_id"] for r in wide_simhash.drop_similar(df).collect()} == {1, 3, 4}  # 5 repeats the shingles of 1
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    for r in bpe.encode_texts(df.where("doc_id in (1, 4)"), path).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"], add_special_tokens=False).ids
    hits = {r["doc_id"]: r["n_hit"] for r in decontaminate.find_contamination(df, df.where("doc_id = 5").select(F.col("doc_id").alias("item_id"), "text")).collect()}
    assert hits[1] >= 149_000 and hits[3] == hits[4] == 0
    shards = sharding.assign_shards(df, "doc_id", 3).collect()
    assert len(shards) == 5


def test_names_that_clash(spark, docs):
    """Columns named as inner or made ones are not looked at, or are dropped as the docstrings say."""
    inner = ("id", "fp", "key", "node", "set", "print", "keys", "a", "b", "of", "kept_id", "goes", "stays", "hash", "size", "part", "share", "ids", "host", "path", "evidence", "text_hash")
    more = docs.withColumns({c: F.lit("clash") for c in inner})
    same = lambda f: sorted(map(str, f(docs).collect())) == sorted(map(str, f(more).collect()))
    assert same(simhash.near_duplicates) and same(wide_simhash.similar_documents) and same(chunks.edited_and_next)
    known = spark.createDataFrame([(r["doc_id"], k % 2, 0) for k, r in enumerate(docs.collect())], "doc_id long, quality int, toxic int")
    assert same(lambda d: quality.classify(d, known).select("doc_id", "p_bad"))
    for keep in (simhash.drop_near_duplicates, wide_simhash.drop_similar, lambda d: quality.reject_bad(d, known)):
        assert sorted(map(str, keep(more).select(*docs.columns).collect())) == sorted(map(str, keep(docs).collect())) and keep(more).columns == more.columns


def test_cut_when_tasks_come_again(spark, tmp_path):
    """A task that fails once and is run again leaves its rows once; empty tables keep their columns."""
    mark = str(tmp_path / "failed")

    def once(batches):
        import os

        from pyspark import TaskContext

        yield from batches
        if TaskContext.get().partitionId() == 1 and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost")

    from pyspark.sql import SparkSession

    df = spark.range(100, numPartitions=4)
    try:
        kept = runtime.cut(df, once, "id long")
    except Exception:  # noqa: BLE001  a local master does not run a task again, so the whole cut is
        kept = runtime.cut(df, once, "id long")
    assert sorted(r["id"] for r in kept.collect()) == list(range(100))
    none = runtime.cut(df.where("id < 0"))
    assert none.columns == ["id"] and none.count() == 0
    runtime.release(none)
    assert SparkSession.getActiveSession() is not None


# --- shared helpers


def test_word_spans():
    texts = ["", " a", "b", "c d ", "", "ee"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    starts, ends, first = textops.word_spans(raw, offsets, textops.NOT_SPACE)
    found = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert found == ["a", "b", "c", "d", "ee"] and first.tolist() == [0, 0, 1, 2, 4, 4, 5]
    hashes = textops.span_hashes(raw, starts, ends)
    assert len(set(hashes.tolist())) == 5
    again = textops.span_hashes(np.frombuffer(b"x ee", np.uint8), np.array([2]), np.array([4]))
    assert again[0] == hashes[4]


def test_digest_of_empty_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
