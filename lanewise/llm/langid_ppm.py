"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of orders 0 to 3, grown from labelled text and then
frozen. A byte's code length in a language follows the escape rule: the longest context of the
tree that ends before the byte codes it with n / (T + D), or escapes with D / (T + D) to the next
shorter one, in which bytes already offered by the longer one are excluded (T occurrences of D
different bytes). Below order 0 all bytes are equally likely. The language whose tree codes the
whole text in the fewest bits is predicted.

Statistics are frozen, so a code length depends on four bytes only. `fit` writes out these lengths
for each context of a tree and each byte, and `predict` sums them over whole texts with two table
look-ups a byte.

Defined results: null texts and texts without a letter are `und` with score 0. Training rows with
null text or null label are left out. A tie goes to the language that sorts first. Columns of the
input other than the named ones are neither read nor returned, but by `keep_known_languages`, which returns
all as they are, whatever their names. Repeated rows are judged each. Empty tables teach nothing and give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import coded, decoded, text_chunks

ORDER = 3
#: Training texts of a language at most, on average: a documented bound, filled by a hash of the row.
TRAIN_ROWS_PER_LANGUAGE = 1500
#: Bytes of text of a language in the sample, on average over samples: where texts are long, fewer are drawn.
TRAIN_BYTES_PER_LANGUAGE = 16 << 20
#: Contexts of orders 2 and 3 seen less often than this in all languages together are cut from the trees.
MIN_CONTEXT = 12
#: Bytes of average evidence that the score's posterior rests on.
SCORE_BYTES = 64


@dataclass
class PpmModel:
    languages: list[str]
    symbol: np.ndarray  # uint8 byte -> symbol; unseen bytes share symbol 0
    row_of: np.ndarray  # three symbols -> row of bits
    bits: np.ndarray  # (row * symbols + symbol, language) -> code length

    @property
    def n_symbols(self) -> int:
        return int(self.symbol.max()) + 1

    def code_lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and the texts' bytes."""
        n, s = len(column), self.n_symbols
        total, size = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        for row, data, offsets in text_chunks(column, pad=ORDER):
            sym = self.symbol[data].astype(np.int32)
            context = (sym[:-3] * s + sym[1:-2]) * s + sym[2:-1]
            at = self.row_of[context] * s + sym[3:]
            lengths = self.bits[at]
            starts, ends = offsets[:-1] - ORDER, offsets[1:] - 2 * ORDER
            size[row : row + len(starts)] = ends - starts
            some = np.flatnonzero(ends > starts)
            if len(some):
                cuts = np.column_stack([starts[some], ends[some]]).ravel()
                # the last segment runs to the end, which is also the end of the last text
                cuts = cuts[:-1] if cuts[-1] >= len(lengths) else cuts
                total[row + some] = np.add.reduceat(lengths, cuts, axis=0, dtype=np.float64)[::2]
        return total, size


def count_grams(texts: DataFrame, text: str, label: str) -> DataFrame:
    """(label, gram, n): how often each four bytes in a row occur, three zero bytes before each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), dtype=object)
            for row, data, offsets in text_chunks(batch.column(0), pad=ORDER):
                wide = data.astype(np.uint32)
                gram = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
                keep = np.ones(len(gram), bool)  # without those that end in the next text's padding
                for k in range(1, ORDER + 1):
                    keep[(offsets[1:-1] - ORDER - k)[offsets[1:-1] >= ORDER + k]] = False
                own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(gram)]
                for name in set(labels[row : row + len(offsets) - 1]):
                    grams, counts = np.unique(gram[keep & (labels[row + own] == name)], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["label", "gram", "n"])

    return texts.select(text, label).mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def _tables(counts: np.ndarray, parent_row: np.ndarray | None, parent: np.ndarray | None, parent_bits: np.ndarray | None, parent_escape: np.ndarray | None, alphabet: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths (context, symbol) of one order in one language, and each context's escape bits."""
    total, different = counts.sum(1), (counts > 0).sum(1)
    some = total > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(some, -np.log2(different / (total + different)), 0.0)
        seen = -np.log2(counts / (total + different)[:, None])
    if parent is None:
        below = np.broadcast_to(np.log2(float(alphabet)), counts.shape)
    else:
        up = parent[parent_row]
        left = np.where(counts > 0, 0, up)
        t, d = left.sum(1), (left > 0).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            offered = -np.log2(left / (t + d)[:, None])
            again = np.where(d > 0, -np.log2(d / (t + d)), 0.0)
        rest = parent_bits[parent_row] - parent_escape[parent_row][:, None]
        below = np.where(left > 0, offered, again[:, None] + rest)
    return np.where(counts > 0, seen, escape[:, None] + below), escape


def build_model(grams: pa.Table, min_context: int = MIN_CONTEXT) -> PpmModel:
    """The frozen trees from the table (label, gram, n)."""
    if grams.num_rows == 0:
        return PpmModel([], np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    named = grams.column("label").combine_chunks().dictionary_encode()
    languages = sorted(named.dictionary.to_pylist())
    lang = np.array([languages.index(x) for x in named.dictionary.to_pylist()])[named.indices.to_numpy()]
    gram, n = (grams.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
    last = gram & 255
    bytes_seen = np.unique(np.append(last, 0))  # the padding byte is known as a context
    symbol = np.zeros(256, np.uint8)
    symbol[bytes_seen] = np.arange(1, len(bytes_seen) + 1) if len(bytes_seen) < 255 else np.arange(len(bytes_seen))
    s, count = int(symbol.max()) + 1, len(languages)
    a, b, c, x = (symbol[(gram >> k) & 255].astype(np.int64) for k in (24, 16, 8, 0))
    bits, starts = [], [0]
    # of the order before: its row of each context, tables of each language, kept contexts
    row, parents, keys = np.zeros(0, np.int32), [], np.zeros(0, np.int64)
    for order, code in enumerate((np.zeros_like(c), c, b * s + c, (a * s + b) * s + c)):
        size = s**order
        seen = np.bincount(code, weights=n, minlength=size)
        if order > 1:
            # a context stays only with its shorter one
            seen[np.tile(row, s) < starts[-2]] = 0
        kept = np.flatnonzero(seen >= (min_context if order > 1 else 1))
        del seen
        index = np.full(size, -1, np.int32)
        index[kept] = np.arange(len(kept))
        at = index[code].astype(np.int64)
        del index
        parent_row = None if order == 0 else np.searchsorted(keys, kept % (size // s))
        out, counts, escapes = [], [], []
        for k in range(count):
            own = (lang == k) & (at >= 0)
            table = np.bincount(at[own] * s + x[own], weights=n[own], minlength=len(kept) * s).reshape(len(kept), s)
            shorter = [tables[k] for tables in parents] if order else [None, None, None]
            lengths, escape = _tables(table, parent_row, *shorter)
            out.append(lengths)
            counts.append(table)
            escapes.append(escape)
        parents, keys = (counts, out, escapes), kept
        bits.append(np.stack([o.astype(np.float32) for o in out], axis=-1).reshape(len(kept) * s, count))
        base = starts[-1]
        row = np.zeros(size, np.int32) if order == 0 else np.tile(row, s)
        row[kept] = base + np.arange(len(kept))
        starts.append(base + len(kept))
    del parents, counts, out, escapes
    return PpmModel(languages, symbol, row, np.concatenate(bits))


def fit(docs: DataFrame, text: str = "text", label: str = "lang", rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE, bytes_per_language: int = TRAIN_BYTES_PER_LANGUAGE) -> PpmModel:
    """Trees of all languages named in docs.

    Of each language a sample of whole texts is read, chosen by a hash of the text's row (`rows_per_language` or
    `bytes_per_language`, whichever is less, on average): the share that this needs comes from totals over all rows. So the
    counts that reach the driver, as Arrow, are bounded for each language by its bytes.
    """
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    totals = labelled.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("size")).collect()
    share = {r[0]: min(1.0, rows_per_language / r["n"], bytes_per_language / max(r["size"], 1)) for r in totals}
    draw = (F.xxhash64(F.col("doc_id"), F.lit("ppm")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    taken = draw < (F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col(label)] if share else F.lit(0.0))
    sample = labelled.where(taken).select(F.lower(text).alias("text"), F.col(label).alias("label"))
    return build_model(count_grams(sample, "text", "label").toArrow())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: PpmModel, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns with lang_pred, score and bits_per_byte (in the predicted language).

    score is the predicted language's posterior from the mean code lengths over SCORE_BYTES bytes,
    all languages being equally likely before.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            bits, size = m.code_lengths(batch.column("_text"))
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            known = letters & (size > 0) & (len(m.languages) > 0)
            mean = bits / np.maximum(size, 1)[:, None]
            if m.languages:
                best = mean.argmin(1)
                low = mean[np.arange(len(mean)), best]
                weight = np.exp2(-(mean - low[:, None]) * np.minimum(size, SCORE_BYTES)[:, None])
                score = np.where(known, 1 / weight.sum(1), 0.0)
                names = np.where(known, np.array(m.languages, dtype=object)[best], "und")
            else:
                low, score, names = np.zeros(len(mean)), np.zeros(len(mean)), np.full(len(mean), "und", dtype=object)
            rest = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.record_batch([*rest, pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(np.where(known, low, 0.0))], names=[*batch.schema.names[:-2], "lang_pred", "score", "bits_per_byte"])

    source = docs.select(*keep, F.lower(text).alias("_text"), has_letter(F.col(text)).alias("_letters"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])
    return source.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits_per_byte double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; rows that are held out teach nothing."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    keyed = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(keyed, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


#: A document stays if its language is known with at least this score.
KEEP_SCORE = 0.5


def keep_known_languages(docs: DataFrame, min_score: float = KEEP_SCORE) -> DataFrame:
    """The documents, all columns kept, whose language is known with at least min_score."""
    named = docs.select("doc_id", "text", "lang")
    model = fit(named.where(~held_out(F.col("doc_id"))))
    rows, names = coded(docs), docs.columns
    judged = predict(rows, model, rows.columns, f"c{names.index('text')}")
    return decoded(judged.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)), names)
