"""Corpus encoding with a public byte-level BPE: words split in Spark, each distinct word encoded once, ids joined back by position.

The distinct words are counted with a combine before the shuffle and encoded once each. A histogram of their uses gives the least number of uses from which all words together stay within
FREQUENT_BYTES: these words, however long, go to every worker and resolve whole arrays of words at once, so the positions of a text are never shuffled. Words used less often are met by a join of their
positions alone, and their ids are put in place between those of the others.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sillok.session import scratch_path, stored

#: Where the public vocabularies lie; a parameter of every function, read by the driver only.
VOCABULARIES = os.environ.get("SILLOK_TOKENIZERS", "/opt/tokenizers")
#: Most bytes of words and ids that are broadcast.
FREQUENT_BYTES = 32 << 20
#: Steps of the histogram of uses for each doubling.
STEPS = 16
#: The published split of the byte-level BPE, once for the JVM and once for the encoder.
JAVA_SPLIT = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PYTHON_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_KEY, _WORDS = "__sillok_text_key", "__sillok_words"


def vocabulary(spark: SparkSession, folder: str, name: str) -> Broadcast:
    """The vocabulary file as a broadcast value; its size is that of the published file."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast((name, f.read()))


def _encoding(held: Broadcast):
    """One encoder a worker; the module of the pickled function is not importable there, so the cache sits on tiktoken."""
    import tiktoken

    store = tiktoken.__dict__.setdefault("_sillok_encoders", {})
    name, raw = held.value
    if name not in store:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        store[name] = tiktoken.Encoding(name, pat_str=PYTHON_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return store[name]


def encoded_column(text: Column, held: Broadcast) -> Column:
    """Ids of each text, split included; used for distinct words and for texts the JVM's tables cannot split."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encoding = _encoding(held)
        return pd.Series([None if t is None else encoding.encode_ordinary(t) for t in texts], dtype=object)

    return ids(text)


def _strange(text: Column) -> Column:
    """Texts with characters the JVM's Unicode tables do not know; the encoder splits them itself."""
    return F.coalesce(text.rlike(r"\p{Cn}"), F.lit(False))


def split_words(text: Column) -> Column:
    """The words of a text in order; none for null, empty and strange texts."""
    return F.when(~_strange(text), F.regexp_extract_all(text, F.lit(JAVA_SPLIT), F.lit(0)))


@dataclass(frozen=True)
class Words:
    """The distinct words of a corpus: ``table`` (``word, uses, ids``), the frequent ones as a broadcast Arrow table, and the least uses of these (null: all are frequent)."""

    table: DataFrame
    frequent: Broadcast
    least: int | None
    held: Broadcast

    @property
    def rare(self) -> DataFrame:
        return self.table.filter(F.col("uses") < F.lit(self.least if self.least is not None else 0))


def word_table(texts: DataFrame, text: str, folder: str = VOCABULARIES, name: str = "byte_bpe_50k", most_bytes: int = FREQUENT_BYTES) -> Words:
    """The words of all texts, encoded once each."""
    spark = texts.sparkSession
    held = vocabulary(spark, folder, name)
    counted = texts.select(F.explode(split_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    table = stored(counted.withColumn("ids", encoded_column(F.col("word"), held)), scratch_path(spark, "words"))
    step = F.floor(F.log2("uses") * STEPS).cast("int")
    bytes_ = F.octet_length("word") + 4 * F.size("ids") + 16
    steps = table.groupBy(step.alias("step")).agg(F.sum(bytes_).alias("bytes"), F.min("uses").alias("least")).orderBy(F.desc("step")).collect()  # at most 64 * STEPS rows
    total, least = 0, 1 << 62
    for row in steps:
        total += row["bytes"]
        if total > most_bytes:
            break
        least = row["least"]
    else:
        least = None
    chosen = table if least is None else table.filter(F.col("uses") >= F.lit(least))
    arrow = chosen.select("word", "ids").toArrow().combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrow.schema) as out:
        out.write_table(arrow)
    return Words(table, spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), least, held)


def _lookup(frequent: Broadcast) -> tuple[pa.Array, pa.Array]:
    """Words and ids of the broadcast table, read once a worker."""
    store, raw = pa.__dict__.setdefault("_sillok_words", {}), frequent.value
    if store.get("raw") is not raw:
        table = pa.ipc.open_stream(raw).read_all().combine_chunks()
        one = lambda c: table[c].chunk(0) if table[c].num_chunks else pa.array([], table.schema.field(c).type)
        store.update(raw=raw, words=one("word"), ids=one("ids"))
    return store["words"], store["ids"]


def _found(words: pa.Array, frequent: Broadcast) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Of an array of word lists: their lengths, the flat words, the place of each in the frequent table (null: rare) and the table's ids."""
    known, ids = _lookup(frequent)
    flat = pc.dictionary_encode(words.flatten())
    at = pc.take(pc.index_in(flat.dictionary, value_set=known), flat.indices)
    lengths = pc.fill_null(pc.list_value_length(words), 0)
    return lengths, flat, at, ids


def resolved(words: Column, table: Words) -> Column:
    """The ids of the frequent words of each array, in order; rare words leave nothing."""
    frequent = table.frequent

    @F.arrow_udf("array<int>")
    def ids(words: pa.Array) -> pa.Array:
        lengths, _, at, known = _found(words, frequent)
        lists = pc.take(known, at)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False))))
        return pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), lists.flatten())

    return ids(words)


def resolved_size(words: Column, table: Words) -> Column:
    """The number of ids of the frequent words of each array."""
    frequent = table.frequent

    @F.arrow_udf("bigint")
    def size(words: pa.Array) -> pa.Array:
        lengths, _, at, known = _found(words, frequent)
        sizes = pc.fill_null(pc.take(pc.list_value_length(known), at), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False))))
        return pa.array((before[ends[1:]] - before[ends[:-1]]).astype(np.int64))

    return size(words)


def rare_positions(words: Column, table: Words) -> Column:
    """``pos, at, word`` of the rare words of each array: their position and the number of ids the frequent words before them have."""
    frequent = table.frequent

    @F.arrow_udf("array<struct<pos:int,at:int,word:string>>")
    def rare(words: pa.Array) -> pa.Array:
        lengths, flat, at, known = _found(words, frequent)
        missing = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        sizes = pc.fill_null(pc.take(pc.list_value_length(known), at), 0).to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.concatenate(([0], np.cumsum(lengths.to_numpy(zero_copy_only=False))))
        owner = np.searchsorted(ends, missing, "right") - 1
        spots = [pa.array((missing - ends[owner]).astype(np.int32)), pa.array((before[missing] - before[ends[owner]]).astype(np.int32)), pc.take(flat.dictionary, flat.indices.take(pa.array(missing))).cast(pa.string())]
        counts = np.bincount(owner, minlength=len(lengths))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.StructArray.from_arrays(spots, ["pos", "at", "word"]))

    return rare(words)


def _rare_by_text(df: DataFrame, text: str, table: Words) -> DataFrame:
    """``key, pos, at, ids`` of the rare words of each distinct text; copies are merged before the join."""
    spots = df.filter(F.length(text) > 0).select(F.unhex(F.md5(text)).alias(_KEY), F.explode(rare_positions(split_words(F.col(text)), table)).alias("s")).select(_KEY, "s.*").distinct()
    return spots.join(table.rare.select("word", "ids"), "word").select(_KEY, "pos", "at", F.col("ids").alias("_ids"))


def _spliced(ids: Column, rare: Column) -> Column:
    """``ids`` with the lists of ``rare`` (ordered ``pos, at, _ids``) put in before position ``at``."""
    starts = F.concat(F.array(F.lit(0)), F.transform(rare, lambda r: r["at"]))
    heads = F.zip_with(F.transform(rare, lambda r: r["at"]), F.slice(starts, 1, F.size(rare)), lambda end, begin: F.slice(ids, begin + 1, end - begin))
    inner = F.flatten(F.zip_with(heads, rare, lambda h, r: F.concat(h, r["_ids"])))
    last = F.element_at(starts, -1)
    return F.concat(inner, F.slice(ids, last + 1, F.size(ids) - last))


def encode(df: DataFrame, text: str, ids: str = "ids", folder: str = VOCABULARIES, name: str = "byte_bpe_50k", most_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """``df`` with the token ids of ``text``, without special tokens; null and empty texts have an empty array.

    Repeated rows and equal texts keep their rows; the other columns stay as they are. Text of special tokens is ordinary text.
    """
    table = word_table(df, text, folder, name, most_bytes)
    none = F.array().cast("array<int>")
    whole = encoded_column(F.when(_strange(F.col(text)), F.col(text)), table.held)
    out = df.withColumns({ids: resolved(split_words(F.col(text)), table), _WORDS: whole})
    if table.least is not None:
        lists = _rare_by_text(df, text, table).groupBy(_KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "at", "_ids"))).alias("_rare"))
        out = out.withColumn(_KEY, F.unhex(F.md5(text))).join(lists.withColumnRenamed("_rare", _KEY + "_rare"), _KEY, "left")
        spliced = F.when(F.col(_KEY + "_rare").isNull(), F.col(ids)).otherwise(_spliced(F.col(ids), F.col(_KEY + "_rare")))
        out = out.withColumn(ids, spliced).drop(_KEY, _KEY + "_rare")
    return out.withColumn(ids, F.coalesce(_WORDS, ids, none)).drop(_WORDS)


def token_counts(df: DataFrame, text: str, tokens: str = "tokens", folder: str = VOCABULARIES, name: str = "byte_bpe_50k", most_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """``df`` with the number of tokens of ``text`` (bigint); no array of ids is ever made. Null and empty texts have 0."""
    table = word_table(df, text, folder, name, most_bytes)
    whole = F.size(encoded_column(F.when(_strange(F.col(text)), F.col(text)), table.held)).cast("long")
    out = df.withColumns({tokens: resolved_size(split_words(F.col(text)), table), _WORDS: F.when(_strange(F.col(text)), whole)})
    if table.least is not None:
        more = _rare_by_text(df, text, table).groupBy(_KEY).agg(F.sum(F.size("_ids")).alias(_KEY + "_more"))
        out = out.withColumn(_KEY, F.unhex(F.md5(text))).join(more, _KEY, "left")
        out = out.withColumn(tokens, F.col(tokens) + F.coalesce(_KEY + "_more", F.lit(0))).drop(_KEY, _KEY + "_more")
    return out.withColumn(tokens, F.coalesce(_WORDS, tokens, F.lit(0).cast("long"))).drop(_WORDS)


def decode(encoded: DataFrame, key: str, ids: str = "ids", folder: str = VOCABULARIES, name: str = "byte_bpe_50k") -> DataFrame:
    """``key, text`` of encoded rows through a join of ids with their pieces; empty arrays give empty texts. The vocabulary bounds the broadcast."""
    spark = encoded.sparkSession
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        pieces = spark.createDataFrame([(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, lines)], "id int, piece binary")
    flat = encoded.select(key, F.posexplode_outer(ids).alias("_pos", "id")).join(F.broadcast(pieces), "id", "left")
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("_pos", F.hex("piece").alias("h")))), F.lit(""), lambda text, x: F.concat(text, F.coalesce(x["h"], F.lit(""))))
    return flat.groupBy(key).agg(F.decode(F.unhex(joined), "UTF-8").alias("text"))
