"""Removal of repeated passages by suffix arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller id. All strings of
that length are judged, on the input.

Sorting every suffix of a corpus in one order would move it many times. Instead each string is sent to the bucket of
its anchor: of the `ANCHOR`-byte strings in it the one with the smallest hash, the leftmost of equals. Equal strings
have equal anchors at equal places, so all copies of a string meet in one bucket, and a bucket's suffix array decides
on its strings alone. The steps:

1. Texts are dealt to chunks by a hash of the id and the text and written as a table bucketed by chunk, so that they
   move once.
2. Each chunk lists its distinct anchors. The buckets tell which of them occur in several documents; the others
   cannot repeat, and their surroundings need not move.
3. Each chunk sends the surroundings of the remaining anchors, distinct within the chunk, to the buckets, each with the
   smallest id that it has here. A passage that fills a third of all rows costs one row for each chunk.
4. A bucket sorts the suffixes in two stages (`suffix_array`) and computes their adjacent common prefixes. Runs with
   `LENGTH` bytes in common are equal strings; the smallest id in a run removes it elsewhere.
5. A mask for each of its surroundings goes back to a chunk, which knows where they occur and cuts the texts.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import checkpoint_dir, checkpointed, parts_for, read_table, release, remove_folder
from kindred.llm.suffix_array import Strings

#: Bytes of a string that must repeat, and of an anchor.
LENGTH, ANCHOR = 50, 20
#: Places of an anchor in its string, and bytes of an anchor's surroundings.
PLACES = LENGTH - ANCHOR + 1
AROUND = PLACES - 1 + LENGTH
#: Bytes of text of a chunk, and of the text whose anchors a bucket gets, on average; the most table buckets.
CHUNK_BYTES, BUCKET_BYTES, MOST = 4 << 20, 2 << 20, 50_000
#: Positions whose anchors are looked for at a time.
SPAN = 1 << 16
#: An odd number, its inverse modulo 2**64, and two multipliers of a well-known mixing function.
BASE, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
NO_ID = np.iinfo(np.int64).max


def powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


POWERS, INVERSES = powers(BASE, SPAN + 2 * LENGTH), powers(pow(BASE, -1, 1 << 64), SPAN + 2 * LENGTH)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a chunk's texts; `ends[i]` is where the document of byte i ends."""
    places, hashes, n = [], [], len(text)
    for a in range(0, max(0, n - LENGTH + 1), SPAN):
        stop = min(a + SPAN, n - LENGTH + 1)
        part = text[a : stop + LENGTH - 1].astype(np.uint64) + np.uint64(7)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * POWERS[: len(part)])])
        grams = len(part) - ANCHOR + 1
        h = mixed((sums[ANCHOR:] - sums[:grams]) * INVERSES[:grams])
        key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(grams, dtype=np.uint64)
        low = key
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: -(PLACES - 16)], low[PLACES - 16 :])
        at = low[ends[a:stop] - np.arange(a, stop, dtype=np.int32) >= LENGTH] & np.uint64((1 << 24) - 1)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        at = at.astype(np.int64)
        places.append(at + a)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    place, h = np.concatenate(places), np.concatenate(hashes)
    keep = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, dtype=bool)
    return place[keep], h[keep]


class Chunk:
    """The texts of a chunk in order of id and version: one array, where each begins, and their anchors."""

    def __init__(self, table: pa.Table, buckets: int, search: bool = True):
        ids = [NO_ID if i is None else i for i in table.column("_id").to_pylist()]
        versions = table.column("_version").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], versions[i]))
        texts = [t or b"" for t in table.column("_text").to_pylist()]
        texts = [texts[i] for i in self.order]
        self.ids = np.array([ids[i] for i in self.order], dtype=np.int64)
        self.text = np.frombuffer(b"".join(texts), dtype=np.uint8)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(lengths)])
        if search:
            self.ends = np.repeat(self.begins[1:].astype(np.int32), lengths)
            self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
            self.place, h = anchors(self.text, self.ends)
            # an anchor goes by its bucket and 32 bits more: a chance meeting costs work, not rightness
            self.code = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes, sorted, and whether each has several documents in this chunk."""
        codes, inverse = np.unique(self.code, return_inverse=True)
        owner = self.owner[self.place]
        low, high = np.full(len(codes), len(self.ids), dtype=np.int32), np.full(len(codes), -1, dtype=np.int32)
        np.minimum.at(low, inverse, owner)
        np.maximum.at(high, inverse, owner)
        return codes, low < high


def by_bucket(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """Bucket, begin and end of each bucket's run in sorted codes."""
    if not len(codes):
        return []
    bucket = (codes >> np.uint64(32)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(codes)]])
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({k: pa.array(list(c), t) for (k, t), c in zip(kinds.items(), columns, strict=True)})


ANCHOR_KINDS = {"bucket": pa.int32(), "chunk": pa.int32(), "codes": pa.binary(), "several": pa.binary()}
REPLY_KINDS = {"chunk": pa.int32(), "bucket": pa.int32(), "shared": pa.binary()}
AROUND_KINDS = {"bucket": pa.int32(), "chunk": pa.int32(), "around": pa.binary(), "left": pa.binary(), "right": pa.binary(), "least": pa.binary()}
MASK_KINDS = {"chunk": pa.int32(), "bucket": pa.int32(), "mask": pa.binary()}


def ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {'int' if t == pa.int32() else 'binary'}" for k, t in kinds.items())


def shared_codes(rows: pa.Table) -> list[tuple]:
    """For each chunk's codes in a bucket, bits that say which occur in several documents."""
    chunks, codes = rows.column("chunk").to_pylist(), [np.frombuffer(c, dtype="<u4") for c in rows.column("codes").to_pylist()]
    several = [np.unpackbits(np.frombuffer(s, dtype=np.uint8), count=len(c)) for s, c in zip(rows.column("several").to_pylist(), codes, strict=True)]
    _, inverse, counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    counts = counts + np.bincount(inverse, weights=np.concatenate(several), minlength=len(counts))
    bits, at, out = counts[inverse] > 1, 0, []
    for chunk, own in zip(chunks, codes, strict=True):
        if bits[at : at + len(own)].any():
            out.append((chunk, rows.column("bucket")[0].as_py(), np.packbits(bits[at : at + len(own)]).tobytes()))
        at += len(own)
    return out


def same_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct row of a byte matrix, and each row's number among them. Rows that only share a hash
    stay apart; an equal row may then be numbered twice, which costs work but changes no result."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    words[:, :width] = rows
    words = words.view(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(words.shape[1]):
        h = mixed(h ^ words[:, j]) + np.uint64(BASE)
    order = np.argsort(h, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    number = np.empty(n, dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Shared:
    """The shared anchors of a chunk: their distinct surroundings, bucket by bucket (`around`, `left`, `right`, and
    `least`, the smallest id that has them here), and for each place where they occur its surroundings' number (`of`),
    document and place in it, and whether the document's id is the smallest (`first`)."""

    def __init__(self, chunk: Chunk, replies: dict[int, bytes]):
        codes, numbers = np.unique(chunk.code, return_inverse=True)
        shared = np.zeros(len(codes), dtype=bool)
        for bucket, a, b in by_bucket(codes):
            if bucket in replies:
                shared[a:b] = np.unpackbits(np.frombuffer(replies[bucket], dtype=np.uint8), count=b - a).astype(bool)
        found = np.flatnonzero(shared[numbers])
        place, code = chunk.place[found], chunk.code[found]
        self.doc = chunk.owner[place]
        self.at = place - chunk.begins[self.doc]
        left = np.minimum(self.at, PLACES - 1)
        right = np.minimum(chunk.begins[self.doc + 1] - place, LENGTH)
        reach = np.arange(AROUND) - (PLACES - 1)
        rows = np.zeros((len(found), AROUND + 2), dtype=np.uint8)
        inside = (reach >= -left[:, None]) & (reach < right[:, None])
        rows[:, :AROUND] = chunk.text[np.clip(place[:, None] + reach, 0, len(chunk.text) - 1)] * inside
        rows[:, AROUND], rows[:, AROUND + 1] = left, right
        some, of = same_rows(rows)
        order = np.argsort(code[some] >> np.uint64(32), kind="stable")  # equal surroundings have equal anchors, so one bucket
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        some, self.of = some[order], number[of]
        self.least = np.full(len(some), NO_ID, dtype=np.int64)
        np.minimum.at(self.least, self.of, chunk.ids[self.doc])
        self.first = chunk.ids[self.doc] == self.least[self.of]
        self.around, self.left, self.right = rows[some, :AROUND], rows[some, AROUND], rows[some, AROUND + 1]
        self.buckets = by_bucket(code[some])

    def sent(self, chunk_number: int) -> list[tuple]:
        """What goes to each bucket."""
        return [
            (bucket, chunk_number, self.around[a:b].tobytes(), self.left[a:b].tobytes(), self.right[a:b].tobytes(), self.least[a:b].astype("<i8").tobytes())
            for bucket, a, b in self.buckets
        ]

    def masks(self, answers: dict[int, bytes]) -> np.ndarray:
        """A mask for each place: bit o says that the string which begins o bytes into its surroundings also starts in
        a document with a smaller id. `answers` hold those for the documents with the smallest id here; in all others
        every whole string does."""
        own = np.zeros(len(self.least), dtype=np.int64)
        for bucket, a, b in self.buckets:
            if bucket in answers:
                own[a:b] = np.frombuffer(answers[bucket], dtype="<u4")
        return np.where(self.first, own[self.of], whole_strings(self.left, self.right)[self.of])


BIT = np.int64(1) << np.arange(PLACES, dtype=np.int64)


def whole_strings(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits of the places in surroundings where a string of `LENGTH` bytes begins and ends in the document."""
    columns, begin, end = np.arange(PLACES), PLACES - 1 - left.astype(np.int64), PLACES - 1 + right.astype(np.int64)
    return ((columns >= begin[:, None]) & (columns + LENGTH <= end[:, None])) @ BIT


def bucket_masks(rows: pa.Table) -> list[tuple]:
    """For each chunk's surroundings in a bucket a mask: bit o says that the string which begins o bytes into them also
    starts in a document with an id smaller than the smallest that the chunk has them in."""
    get = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in rows.column(name).to_pylist()]
    lefts, rights, leasts = get("left", np.uint8), get("right", np.uint8), get("least", "<i8")
    around = np.concatenate([x.reshape(-1, AROUND) for x in get("around", np.uint8)])
    left, right, least = np.concatenate(lefts), np.concatenate(rights), np.concatenate(leasts)
    some, number = same_rows(np.concatenate([around, left[:, None], right[:, None]], axis=1))
    smallest = np.full(len(some), NO_ID, dtype=np.int64)
    np.minimum.at(smallest, number, least)
    begin, end = PLACES - 1 - left[some].astype(np.int64), PLACES - 1 + right[some].astype(np.int64)
    strings = Strings(around[some], begin, end, LENGTH + 6)
    row, at = strings.sort(PLACES)
    whole = at + LENGTH <= end[row]
    row, at = row[whole], at[whole]
    minimum = np.full((len(some), PLACES), NO_ID, dtype=np.int64)  # the smallest id with the string that begins there
    if len(row):
        new = np.concatenate([[True], strings.common_prefixes(row, at, LENGTH) < LENGTH])
        minimum[row, at] = np.minimum.reduceat(smallest[row], np.flatnonzero(new))[np.cumsum(new) - 1]
    out, base = [], 0
    for chunk, bucket, size in zip(rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist(), map(len, leasts), strict=True):
        mask = (minimum[number[base : base + size]] < least[base : base + size, None]) @ BIT
        if mask.any():
            out.append((chunk, bucket, mask.astype("<u4").tobytes()))
        base += size
    return out


def cover(chunk: Chunk, shared: Shared, answers: dict[int, bytes]) -> np.ndarray:
    """Which bytes of a chunk go."""
    begins = np.zeros(len(chunk.text) + 1, dtype=bool)
    bits = shared.masks(answers)
    start = chunk.begins[shared.doc] + shared.at - (PLACES - 1)
    for o in range(PLACES):
        begins[start[(bits >> o & 1).astype(bool)] + o] = True
    upto = np.cumsum(begins[:-1], dtype=np.int32)
    before = np.zeros_like(upto)
    before[LENGTH:] = upto[:-LENGTH] if len(upto) > LENGTH else upto[:0]
    return upto > before


def answers_of(rows: pa.Table, column: str) -> dict[int, bytes]:
    """Bucket to what it says, of the rows that have the column."""
    return {bucket: said for bucket, said in zip(rows.column("bucket").to_pylist(), rows.column(column).to_pylist(), strict=True) if said is not None}


_TABLES: list[tuple[SparkSession, str, str]] = []


def drop_tables() -> None:
    """Drop the chunk tables of `without_repeats`; done at exit too. Its results can't be read afterwards."""
    while _TABLES:
        spark, name, folder = _TABLES.pop()
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_folder(spark, folder)


atexit.register(drop_tables)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row` (the input row as a struct), `kept` (the bytes that stay), `n_bytes`, `n_removed` and `n_spans` (maximal
    removed runs) for each row of `docs`, whatever its columns are called.

    A null text counts as empty. Rows with one id never remove each other's bytes; rows without an id come after all
    others and don't remove each other's either. An empty table gives an empty result. The result reads a table
    whose files lie in the checkpoint folder, until `drop_tables` removes it.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row") if len(docs.columns) > 1 else F.struct(F.lit(None).cast("string").alias("_")).alias("row"),
    )
    total = own.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    chunks, buckets = parts_for(total, CHUNK_BYTES), parts_for(total, BUCKET_BYTES)
    parts = min(chunks, MOST)
    name = f"kindred_chunks_{uuid.uuid4().hex}"
    own = own.withColumn("_version", F.xxhash64("_text")).withColumn("_chunk", F.pmod(F.xxhash64("_id", "_version"), F.lit(chunks)).cast("int"))
    folder = f"{checkpoint_dir(spark)}/{name}"
    own.repartition(parts, "_chunk").write.bucketBy(parts, "_chunk").option("path", folder).format("parquet").saveAsTable(name)
    _TABLES.append((spark, name, folder))
    texts = spark.table(name)
    search = texts.select("_chunk", "_id", "_version", "_text")

    def list_anchors(key: tuple, rows: pa.Table) -> pa.Table:
        codes, several = Chunk(rows, buckets).distinct()
        low = (codes & np.uint64(0xFFFFFFFF)).astype("<u4")
        return table([(k, key[0].as_py(), low[a:b].tobytes(), np.packbits(several[a:b]).tobytes()) for k, a, b in by_bucket(codes)], ANCHOR_KINDS)

    listed = search.groupBy("_chunk").applyInArrow(list_anchors, ddl(ANCHOR_KINDS))
    replies = checkpointed(listed.groupBy("bucket").applyInArrow(lambda rows: table(shared_codes(rows), REPLY_KINDS), ddl(REPLY_KINDS)))

    def send(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = table(Shared(Chunk(rows, buckets), answers_of(answers, "shared")).sent(key[0].as_py()) if len(rows) and len(answers) else [], AROUND_KINDS)
        release()
        return out

    sent = search.groupBy("_chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send, ddl(AROUND_KINDS))
    masks = checkpointed(sent.groupBy("bucket").applyInArrow(lambda rows: table(bucket_masks(rows), MASK_KINDS), ddl(MASK_KINDS)))
    said = replies.withColumn("mask", F.lit(None).cast("binary")).unionByName(masks.withColumn("shared", F.lit(None).cast("binary")))
    row_kind = texts.schema["row"].dataType.simpleString()

    def cut(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(rows, buckets, search=len(found) > 0)
        goes = cover(chunk, Shared(chunk, answers_of(found, "shared")), answers_of(found, "mask")) if len(found) else np.zeros(len(chunk.text), dtype=bool)
        kept, sizes, removed, spans = [], [], [], []
        for a, b in zip(chunk.begins[:-1].tolist(), chunk.begins[1:].tolist(), strict=True):
            own = goes[a:b]
            kept.append(chunk.text[a:b][~own].tobytes())
            sizes.append(b - a)
            removed.append(int(own.sum()))
            spans.append(int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum()))
        ordered = rows.column("row").take(pa.array(chunk.order, pa.int64()))
        return pa.table({"row": ordered, "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())})

    return texts.groupBy("_chunk").cogroup(said.groupBy("chunk")).applyInArrow(cut, f"row {row_kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, o, substr(h, 2 * o + 1, 1122) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 512)) AS o FROM d WHERE length(h) >= 100)
), s AS (
  SELECT doc_id, o + j AS i, substr(h, 2 * j + 1, 100) AS g FROM (SELECT doc_id, o, h, unnest(range(0, least(512, length(h) // 2 - 49))) AS j FROM w)
), m AS (
  SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING count(DISTINCT doc_id) > 1
), r AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s JOIN m USING (g) WHERE least < doc_id
), k AS (
  SELECT doc_id, i, count(*) FILTER (before IS NULL OR i > before + 50) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
), sp AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run
), cut AS (
  SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS from_b FROM sp
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * from_b + 1, 2 * (a - from_b)), '' ORDER BY run) || substr(any_value(h), 2 * max(b) + 1) AS h, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
