"""Token-ID output: a content-addressed chunk store with document recipes and a Merkle manifest.

Layout below one folder:

* ``parts/kind=chunk``: one row for each distinct chunk: ``key`` (blake2b-128 of the payload), ``payload`` (first byte:
  bytes an id takes, 2 or 4; then little-endian ids).
* ``recipes``: one row for each document in the given order, ``doc_id`` unless told otherwise (range-partitioned, sorted
  files): ``refs`` holds the 20-byte references (16-byte key, 4-byte id count) of its chunks in order.
* ``manifest``: Merkle nodes; leaves are chunk keys grouped by key prefix, the root hashes the inner nodes.

A rolling hash over the last four ids cuts the stream, so equal passages give equal chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

END_ID = 1
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 9, 64, 4096
#: Words kept by a worker between batches; beyond this the cache starts anew.
CACHE_WORDS = 400_000
#: Marks that the vocabulary's pattern takes as one piece after a word (an apostrophe may begin a piece of its own).
_MARKS = b".,;:!?#*$%&|+-=/\\()[]{}<>@^_~\"`"
_CACHES: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts with a tokenizers file, one white-space run at a time.

    The vocabulary drops white space before it splits, so a text's ids are those of its runs in order; runs met before come
    from a bounded cache. New words of letters alone are one piece each, so they are encoded together and told apart by
    the ids that end a word; a letter word with marks behind is its word and the marks; whatever else is told apart
    by offsets.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.plain, self.cache = Tokenizer.from_file(path), Tokenizer.from_file(path), {}
        # words of a-z alone need no normalising, and their bytes stand for themselves
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _letters(self, tokenizer, words: list[bytes], n: int = 128) -> None:
        blocks = [words[i : i + n] for i in range(0, len(words), n)]
        for block, found in zip(blocks, tokenizer.encode_batch_fast([b" ".join(b).decode() for b in blocks], add_special_tokens=False)):
            ids = np.asarray(found.ids, "<u4")
            cuts, raw = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
            if len(cuts) == len(block):
                self.cache.update(zip(block, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
            else:
                self._others(block)

    def _others(self, words: list[bytes], n: int = 1000) -> None:
        for k in range(0, len(words), n):
            block = words[k : k + n]
            texts = [w.decode() for w in block]
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
            cuts, raw = (np.searchsorted(at, starts) * 4).tolist(), ids.tobytes()
            self.cache.update((w, raw[i:j]) for w, i, j in zip(block, cuts, cuts[1:]))

    def learn(self, words: set[bytes]) -> None:
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            self.shrink()
        plain = {w for w in words if w.isalpha() and w.islower()}
        letters, others, marked = set(), [], []
        for w in words.difference(plain):
            core = w.rstrip(_MARKS) or w
            if core.isalpha() and core.islower():
                plain.add(core)
            elif (text := core.decode()).isalpha() and text.lower().isalpha():
                letters.add(core)
            else:
                others.append(w)
                continue
            if core is not w:
                marked.append((w, core, w[len(core) :]))
        self._letters(self.plain, list(plain - cache.keys()))
        self._letters(self.tokenizer, [w for w in letters if w not in cache])
        self._others(others + [m for m in {m for _, _, m in marked} if m not in cache])
        cache.update((w, cache[c] + cache[m]) for w, c, m in marked)

    def shrink(self) -> None:
        """Keep short words: long ones seldom come again."""
        short = {w: i for w, i in self.cache.items() if len(w) <= 8}
        self.cache.clear()
        self.cache.update(short if len(short) < CACHE_WORDS // 4 else {})

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text. Arrow splits and numbers the words, so Python sees each distinct word of a batch once."""
        column = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.binary()).cast(pa.string())  # the vocabulary's special names keep their case
        split = pc.ascii_split_whitespace(column)
        numbered = split.flatten().dictionary_encode()
        words, codes = numbered.dictionary.cast(pa.binary()).to_pylist(), numbered.indices.to_numpy(zero_copy_only=False)
        got = list(map(self.cache.get, words))
        self.learn({w for w, g in zip(words, got) if g is None and w})
        got = [g if g is not None else self.cache[w] if w else b"" for w, g in zip(words, got)]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        ids, starts = np.frombuffer(b"".join(got), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        out = ids[np.repeat(starts[codes], each) + shared.ragged(each)]
        ends = np.concatenate([[0], np.cumsum(each)])[split.offsets.to_numpy()]
        return [out[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]


def encoder(path: str) -> WordEncoder:
    if path not in _CACHES:
        _CACHES[path] = WordEncoder(path)
    return _CACHES[path]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids: content-defined, between MIN_CHUNK and MAX_CHUNK ids long."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = shared.mix64(ids + np.uint64(1))
    roll = h[3:] + (h[2:-1] << np.uint64(1)) + (h[1:-2] << np.uint64(2)) + (h[:-3] << np.uint64(3))
    marks = (np.flatnonzero((roll >> np.uint64(20)) & np.uint64((1 << CUT_BITS) - 1) == 0) + 4).tolist()
    out, last = [], 0
    for m in [*marks, n]:
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if m - last >= MIN_CHUNK or m == n and m > last:
            out.append(m)
            last = m
    return out


def pack(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


PARTS = "kind string, key binary, payload binary, doc_id bigint, rid string, n_tokens bigint, refs binary"
RECIPES = "doc_id bigint, rid string, n_tokens bigint, refs binary"


def _encode(path: str):
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, count, seen = encoder(path), TaskContext.get().partitionId(), 0, set()
        end = np.asarray([END_ID], "<u4")
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), shared.text_bytes(batch.column(1))
            lo = 0
            while lo < len(all_ids):  # a bounded number of bytes at a time
                hi, size = lo, 0
                while hi < len(all_ids) and size < 8 << 20:
                    size += len(all_texts[hi])
                    hi += 1
                rows, at = [], []  # at: the batch row that a recipe stands for
                for k, (doc, found) in enumerate(zip(all_ids[lo:hi], enc.encode(all_texts[lo:hi])), lo):
                    ids, last, refs = np.concatenate([found, end]), 0, []
                    for cut in cuts(ids):
                        payload = pack(ids[last:cut])
                        key = address(payload)
                        refs.append(key + (cut - last).to_bytes(4, "little"))
                        last = cut
                        if key not in seen:
                            if len(seen) >= 200_000:
                                seen.clear()
                            seen.add(key)
                            rows.append(("chunk", key, payload, None, None, None, None))
                            at.append(None)
                    rid = f"{task}-{count}"
                    count += 1
                    rows.append(("recipe", address(rid.encode()), None, doc, rid, len(ids), b"".join(refs)))
                    at.append(k)
                cols = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.binary()))]
                take, places = pa.array(at, pa.int64()), batch.schema.names[2:]
                yield pa.RecordBatch.from_arrays([*cols, *(batch.column(c).take(take) for c in places)], ["kind", "key", "payload", "doc_id", "rid", "n_tokens", "refs", *places])
                lo = hi
        if len(enc.cache) > CACHE_WORDS // 2:
            enc.shrink()

    return shared.tidy(run)


@shared.tidy
def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of the key, the first of each key."""
    last = None
    for batch in batches:
        keys = batch.column(1).to_pylist()
        keep = [a != b for a, b in zip(keys, [last, *keys])]
        last = keys[-1] if keys else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, order: tuple[str, ...] = ("doc_id",)) -> None:
    """Encode ``docs`` (doc_id, text) and write the store. Null text is empty: its stream is the end id alone.

    Documents follow one another by the columns of ``order``, nulls first. Repeated rows and rows with one doc_id each get
    a recipe of their own. An empty table gives an empty store; columns beside those named are not read, whatever their names. Texts of any length are encoded
    whole; their ids are cut into chunks of bounded size.
    """
    spark, n = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = [f"at{k}" for k in range(len(order))]
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *(F.col(c).alias(p) for c, p in zip(order, places)))
    typed = ", ".join(f"{p} {given.schema[p].dataType.simpleString()}" for p in places)
    rows = given.mapInArrow(_encode(vocabulary or default_vocabulary()), f"{PARTS}, {typed}")
    rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_once, f"{PARTS}, {typed}").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    recipes = _parts(spark, path, "recipe", f"{RECIPES}, {typed}")
    recipes.repartitionByRange(n, *places, "rid").sortWithinPartitions(*places, "rid").drop(*places).write.parquet(f"{path}/recipes")
    merkle(chunks(spark, path)).write.parquet(f"{path}/manifest")


def _parts(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of one kind; none where no document was written. Spark reads that kind's folder alone."""
    return spark.read.schema(f"{schema}, kind string").parquet(f"{path}/parts").where(F.col("kind") == kind).drop("kind")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return _parts(spark, path, "chunk", "key binary, payload binary")


def merkle(keys: DataFrame) -> DataFrame:
    """level 2: hash of the sorted chunk keys with one 16-bit prefix; level 1: of the nodes with one 8-bit prefix; level 0: the root."""
    node = lambda c: F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(c))), 256)
    leaves = keys.select(F.lower(F.hex("key")).alias("hash")).groupBy(F.substring("hash", 1, 4).alias("prefix")).agg(node("hash").alias("hash"), F.count("*").alias("n"))
    inner = leaves.groupBy(F.substring("prefix", 1, 2).alias("prefix")).agg(node(F.concat_ws(":", "prefix", "hash")).alias("hash"), F.sum("n").alias("n"))
    root = inner.groupBy(F.lit("").alias("prefix")).agg(node(F.concat_ws(":", "prefix", "hash")).alias("hash"), F.sum("n").alias("n"))
    level = lambda df, k: df.select(F.lit(k).alias("level"), "prefix", "hash", "n")
    return level(leaves, 2).unionByName(level(inner, 1)).unionByName(level(root, 0))


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Manifest nodes that the chunks as read back don't confirm; empty if the store is whole."""
    payloads = chunks(spark, path).mapInArrow(_checked, CHECKED)
    now = merkle(payloads.where("sound").select("key"))
    then = spark.read.parquet(f"{path}/manifest")
    return then.join(now.withColumnRenamed("hash", "found"), ["level", "prefix"], "full_outer").where(~F.col("hash").eqNullSafe(F.col("found"))).select("level", "prefix", "hash", "found")


CHECKED = "key binary, sound boolean, n bigint, crc bigint"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read each payload back: does it hash to its key; its number of ids and their CRC-32 as 32-bit ids."""
    for batch in batches:
        keys, rows = batch.column(0).to_pylist(), []
        for key, payload in zip(keys, batch.column(1).to_pylist()):
            ids = unpack(payload)
            rows.append((address(payload) == key, len(ids), zlib.crc32(ids.tobytes())))
        sound, n, crc = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sound, pa.bool_()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["key", "sound", "n", "crc"])


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 values as they stand in a longer string, n_bytes before its end (linear over GF(2))."""
    op = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit

    def apply(m: list[int], v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where((v >> np.uint64(i)) & np.uint64(1), np.uint64(m[i]), np.uint64(0))
        return out

    def square(m: list[int]) -> list[int]:
        return [int(x) for x in apply(m, np.asarray(m, np.uint64))]

    for _ in range(3):
        op = square(op)  # eight zero bits
    crc, left = np.asarray(crc, np.uint64).copy(), np.asarray(n_bytes, np.uint64).copy()
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        crc[odd] = apply(op, crc[odd])
        op, left = square(op), left >> np.uint64(1)
    return crc


REFS = "doc_id bigint, rid string, n_tokens bigint, start bigint, key binary, n bigint, after bigint"


def _refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes to one row for each reference, with the ids that follow it in the document."""
    for batch in batches:
        cols = {name: batch.column(name).to_pylist() for name in ("doc_id", "rid", "n_tokens", "start")}
        lens, keys, ns, after = [], [], [], []
        for refs, total in zip(batch.column("refs").to_pylist(), cols["n_tokens"]):
            n = [int.from_bytes(refs[i + 16 : i + 20], "little") for i in range(0, len(refs), 20)]
            keys += [refs[i : i + 16] for i in range(0, len(refs), 20)]
            ns += n
            after += (total - np.cumsum(n)).tolist()
            lens.append(len(n))
        take = pa.array(np.repeat(np.arange(len(lens)), lens))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("doc_id", "rid", "n_tokens", "start")] + [pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(after, pa.int64())], ["doc_id", "rid", "n_tokens", "start", "key", "n", "after"])


def _part_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = crc_shift(batch.column("crc").to_numpy(zero_copy_only=False), 4 * batch.column("after").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "rid", "n_tokens", "start", "sound")), pa.array(crc.astype(np.int64))], ["doc_id", "rid", "n_tokens", "start", "sound", "part"])


#: Recipes of one file that are summed up together.
RUN = 50_000


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with ``start``: the ids of all documents before, by totals of the sorted files, of runs of RUN rows in each, and a sum
    within a run."""
    rows = spark.read.schema(RECIPES).parquet(f"{path}/recipes").withColumns({"file": F.col("_metadata.file_name"), "nth": F.col("_metadata.row_index")}).withColumn("run", F.floor(F.col("nth") / RUN))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = rows.groupBy("file", "run").agg(F.sum("n_tokens").alias("total"))
    files = runs.groupBy("file").agg(F.sum("total").alias("held"))
    files = files.select("file", earlier("held", W.orderBy("file")).alias("before_file"))  # a row a file
    before = runs.select("file", "run", earlier("total", W.partitionBy("file").orderBy("run")).alias("before_run")).join(files, "file")
    inside = earlier("n_tokens", W.partitionBy("file", "run").orderBy("nth"))
    found = rows.withColumn("inside", inside).join(before, ["file", "run"])
    return found.withColumn("start", F.col("before_file") + F.col("before_run") + F.col("inside")).drop("file", "run", "nth", "before_file", "before_run", "inside")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """What the files hold, for each document: start, n_tokens, CRC-32 of its ids, and whether every chunk hashes to its key.

    Each chunk is read once; its CRC is shifted to its place in the document and the parts are XORed, so no document has
    to be put together in one place.
    """
    refs = recipes(spark, path).mapInArrow(_refs, REFS)
    info = chunks(spark, path).mapInArrow(_checked, CHECKED).withColumnRenamed("n", "n_read")
    # a chunk that most documents share is left to the adaptive skew join, which splits refs: counting them first to deal them out put the query over its budget
    parts = refs.join(info, "key", "left").select("doc_id", "rid", "n_tokens", "start", "after", F.coalesce("crc", F.lit(0)).alias("crc"), F.coalesce(F.col("sound") & (F.col("n") == F.col("n_read")), F.lit(False)).alias("sound"))
    summed = parts.mapInArrow(_part_crc, "doc_id bigint, rid string, n_tokens bigint, start bigint, sound boolean, part bigint")
    return summed.groupBy("doc_id", "rid", "n_tokens", "start").agg(F.expr("bit_xor(part)").alias("ids_crc32"), F.min("sound").alias("sound"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild every document's ids from its recipe: doc_id, rid, ids (array<int>)."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([unpack(p["payload"]) for p in sorted(parts, key=lambda p: -p["after"])]).tolist() for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "rid", "ids"])

    refs = recipes(spark, path).mapInArrow(_refs, REFS)
    return refs.join(chunks(spark, path), "key").groupBy("doc_id", "rid").agg(F.collect_list(F.struct("after", "payload")).alias("parts")).mapInArrow(rebuild, "doc_id bigint, rid string, ids array<int>")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.place(spark, "token-store")
    write_store(shared.table(spark, sf_dir, "documents"), path)
    return read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "sound")
