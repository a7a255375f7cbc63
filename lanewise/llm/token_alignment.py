"""Cross-tokenizer alignment: exact-text deduplication, then tokenise and align each different text once.

A text, with a space before it, is encoded by two tokenizers. Where tokens of both end at the same byte, the
text is cut into groups; tokens of a group are linked, each of one side with each of the other. A pair
of ids counts as many documents as hold it linked.

1. Documents are shuffled by their whole text; each different text is kept once with its number of documents.
2. Texts are cut into segments, at a space behind anything but white space. Neither tokenizer has a token across such
   a place (tests hold this against whole texts), so a segment is encoded and aligned once while it is
   remembered, and a text's measures, links and group string are those of its segments.
3. Texts are worked on in chunks of some megabytes. A chunk asks for the counts of its own different pairs only; pairs
   are summed over chunks, weighted by the texts' documents, and the answers go back to the chunk, where each
   text's links are summed up. So no row a text and pair is ever shuffled.
4. Measures are joined to doc_ids by the text's SHA-256. Texts of more than a thousandth of all documents (there are
   under a thousand of them) are sent to every task, so that no task gets a large group of copies.

Defined results: null and empty texts, and texts that hold U+2581 (which the second tokenizer turns into a
space) or whose tokens' bytes differ from the text for any other reason, have no tokens: zeros and ''. Special tokens'
strings are plain text. Repeated rows and copies count as documents each, and get equal measures. Rows without an id
are kept. Very long texts are a chunk of their own; a group of many tokens is worked on by its different ids.
An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import spread, table, written

FIRST, SECOND = "byte_bpe_50k", "piece_bpe_32k"
#: Bytes of the texts of a chunk, and segments remembered between chunks.
CHUNK, REMEMBERED = 4 << 20, 400_000
#: Texts of more than one in so many documents are broadcast at the end.
HEAVY = 1000
SEGMENT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s*\Z)?|\s+")
#: Bits of a second tokenizer's id in a pair.
LOW = 15
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CHUNKS = "chunk long, digest array<binary>, n array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups_sha256 array<string>, pairs binary, links array<long>, ranks binary, times binary"


@cache
def first_tokenizer():
    """(text -> ids, bytes of each id): the ranks of the byte-level vocabulary, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{FIRST}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding(FIRST, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table_ = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table_[rank] = token
    return coding.encode_ordinary, table_


@cache
def second_tokenizer():
    """(texts -> ids, bytes of each id) of the piece vocabulary; it puts a space before each text itself."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{SECOND}.model"))
    table_ = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        table_.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.encode().replace("▁".encode(), b" "))
    return lambda texts: sp.encode(texts, num_threads=1), table_


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def planes(values: np.ndarray) -> bytes:
    """Whole numbers under 2**32 as four runs of bytes, lowest first, which compress better than the numbers."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Aligner:
    """Segments' tokens, groups and links, remembered by their text."""

    def __init__(self) -> None:
        self.encode_a, self.bytes_a = first_tokenizer()
        self.encode_b, self.bytes_b = second_tokenizer()
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.shown = [form % i for form in (b"%d,", b"%d|", b"%d;") for i in range(len(self.bytes_a))]  # an id within, at the end of the first and of the second side
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.fit, self.strings = np.zeros(0, bool), []
        self.counts = np.zeros((4, 0), np.int64)  # tokens of both sides, groups, links
        self.begin, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers for all segments in a row, how many each has, and which segments' bytes they give.

        Segments may follow each other in a text, so the first tokenizer gets them at once, and its ids are cut at their ends. Where that
        doesn't give the segments' bytes, each is encoded on its own, and those that differ have no ids.
        """
        raw = [s.encode() for s in segments]
        stops, whole = np.cumsum([len(x) for x in raw]), b"".join(raw)
        a, b = self.encode_a("".join(segments)), self.encode_b([s[1:] for s in segments])
        n_b, b = np.fromiter(map(len, b), np.int64, len(b)), list(chain.from_iterable(b))
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        last_a = np.minimum(np.searchsorted(ends_a, stops), len(a) - 1)
        if b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b)) and np.array_equal(ends_a[last_a], stops) and np.array_equal(ends_b[np.cumsum(n_b) - 1], stops):
            return ids_a, np.diff(last_a, prepend=-1), ids_b, n_b, np.ones(len(segments), bool)
        a, b = [self.encode_a(s) for s in segments], self.encode_b([s[1:] for s in segments])
        fit = np.array([b"".join([self.bytes_a[i] for i in x]) == s == b"".join([self.bytes_b[i] for i in y]) for x, y, s in zip(a, b, raw, strict=True)], bool)
        a, b = ([x if ok else [] for x, ok in zip(side, fit, strict=True)] for side in (a, b))
        return *(x for side in (a, b) for x in (np.array([i for x in side for i in x], np.int64), np.array([len(x) for x in side], np.int64))), fit

    def learn(self, segments: list[str]) -> None:
        """Adds new segments; each starts with a space. Those that end in white space only stand last in a text."""
        ends_open = [s for s in segments if s[-1].isspace()]
        inner = [s for s in segments if not s[-1].isspace()]
        for part in ([inner] if inner else []) + [[s] for s in ends_open]:
            self._add(part, *self.encode(part))

    def _add(self, segments: list[str], ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, fit: np.ndarray) -> None:
        end_a, end_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        of_group = np.zeros(len(cuts), np.int64)
        of_group[group_a] = np.repeat(np.arange(len(segments)), n_a)
        size_a, size_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        # links of a group: its different ids of one side with those of the other
        key_a, m_a = summed(group_a << 17 | ids_a, np.ones(len(ids_a), np.int64))
        key_b, m_b = summed(group_b << 17 | ids_b, np.ones(len(ids_b), np.int64))
        n_different_b = np.bincount(key_b >> 17, minlength=len(cuts))
        first_b = np.cumsum(n_different_b) - n_different_b
        width = n_different_b[key_a >> 17]
        left, right = np.repeat(np.arange(len(key_a)), width), spread(first_b[key_a >> 17], width)
        pair = (key_a[left] & 0x1FFFF) << LOW | (key_b[right] & 0x1FFFF)
        owned, times = summed(of_group[key_a[left] >> 17] << 32 | pair, m_a[left] * m_b[right])
        # the group strings: tokens in the order of groups, the first side before the second
        offset = np.cumsum(size_a + size_b) - size_a - size_b
        at_a = offset[group_a] + np.arange(len(ids_a)) - (np.cumsum(size_a) - size_a)[group_a]
        at_b = (offset + size_a)[group_b] + np.arange(len(ids_b)) - (np.cumsum(size_b) - size_b)[group_b]
        shown = np.zeros(len(at_a) + len(at_b), np.int64)
        shown[at_a], shown[at_b] = ids_a, ids_b
        shown[offset + size_a - 1] += len(self.bytes_a)
        shown[offset + size_a + size_b - 1] += 2 * len(self.bytes_a)
        shown = list(map(self.shown.__getitem__, shown.tolist()))
        stops = np.cumsum(n_a + n_b).tolist()
        self.place.update(zip(segments, range(len(self.strings), len(self.strings) + len(segments)), strict=True))
        self.strings += [b"".join(shown[i:j])[:-1] for i, j in zip([0, *stops[:-1]], stops, strict=True)]
        own = owned >> 32
        n_pairs = np.bincount(own, minlength=len(segments))
        n_links = np.bincount(own, weights=times, minlength=len(segments)).astype(np.int64)
        self.fit = np.append(self.fit, fit)
        self.counts = np.concatenate([self.counts, [n_a, n_b, np.bincount(of_group, minlength=len(segments)), n_links]], 1)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(n_pairs))
        self.pair, self.times = np.append(self.pair, owned & 0xFFFFFFFF), np.append(self.times, times)

    def chunk(self, texts: list[str], n: list[int]) -> pa.RecordBatch:
        """One row of CHUNKS for different texts with their numbers of documents; texts without tokens are left out."""
        cut = [SEGMENT.findall(" " + t) for t in texts]
        if len(self.place) > REMEMBERED:
            self.forget()
        flat, sizes = [s for x in cut for s in x], np.array([len(x) for x in cut], np.int64)
        if new := set(flat) - self.place.keys():
            self.learn(sorted(new))
        flat = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        fit = np.logical_and.reduceat(self.fit[flat], np.cumsum(sizes) - sizes) if len(flat) else np.zeros(0, bool)
        kept = np.flatnonzero(fit).tolist()
        flat, sizes = flat[np.repeat(fit, sizes)], sizes[fit]
        begins = np.cumsum(sizes) - sizes
        at = np.split(flat, begins[1:]) if kept else []
        counts = np.add.reduceat(self.counts[:, flat], begins, axis=1) if len(at) else np.zeros((4, 0), np.int64)
        width = (self.begin[1:] - self.begin[:-1])[flat]
        links = spread(self.begin[flat], width)
        of_text = np.repeat(np.repeat(np.arange(len(at)), sizes), width)
        owned, times = summed(of_text << 32 | self.pair[links], self.times[links])
        pairs, ranks = np.unique(owned & 0xFFFFFFFF, return_inverse=True)
        per_text = np.bincount(owned >> 32, minlength=len(at))
        steps = np.diff(ranks, prepend=0)
        first = np.cumsum(per_text) - per_text
        steps[first] = ranks[first]  # a text's ranks rise, so the steps between them are not negative
        digests = [hashlib.sha256(texts[k].encode()).digest() for k in kept]
        groups = [hashlib.sha256(b";".join(map(self.strings.__getitem__, x.tolist()))).hexdigest() for x in at]
        row = [int.from_bytes(digests[0][:8], "big", signed=True) if digests else 0, digests, [n[k] for k in kept], *counts, groups, planes(pairs), per_text, planes(steps), planes(times)]
        kinds = [pa.int64(), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])


def aligned_chunks(docs: DataFrame) -> DataFrame:
    """CHUNKS rows of the different texts of docs."""
    once = docs.where("text is not null and text <> ''").groupBy("text").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, texts, n, size = Aligner(), [], [], 0
        for batch in batches:
            for text, count in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if "▁" in text:
                    continue
                texts.append(text)
                n.append(count.as_py())
                size += len(text)
                if size >= CHUNK:
                    yield aligner.chunk(texts, n)
                    texts, n, size = [], [], 0
        if texts:
            yield aligner.chunk(texts, n)

    return once.mapInArrow(run, CHUNKS)


def asked(chunks: DataFrame) -> DataFrame:
    """chunk, pair, weight: a chunk's different pairs, and the documents of its texts that hold them linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, n, pairs, per_text, ranks = (batch.column(k)[row].as_py() for k in range(5))
                pairs = from_planes(pairs)
                weight = np.bincount(_ranks(from_planes(ranks), per_text), weights=np.repeat(np.array(n, np.float64), per_text), minlength=len(pairs))
                for begin in range(0, len(pairs), 1 << 16):
                    part = pairs[begin : begin + (1 << 16)]
                    yield pa.record_batch([pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(weight[begin : begin + len(part)].astype(np.int64))], names=["chunk", "pair", "weight"])

    return chunks.select("chunk", "n", "pairs", "links", "ranks").mapInArrow(run, "chunk long, pair long, weight long")


def _ranks(steps: np.ndarray, per_text: list[int]) -> np.ndarray:
    """Ranks of each text's pairs from the steps between them."""
    per_text = np.array(per_text, np.int64)
    total = np.cumsum(steps)
    first = np.cumsum(per_text) - per_text
    first = first[per_text > 0]
    return total - np.repeat(total[first] - steps[first], per_text[per_text > 0])


def measures(docs: DataFrame) -> DataFrame:
    """digest, n (documents) and the measures of each different text that has tokens."""
    chunks = written(aligned_chunks(docs), "aligned")
    questions = written(asked(chunks), "asked")
    counts = questions.groupBy("pair").agg(F.sum("weight").alias("count"))
    best = counts.groupBy(F.shiftright("pair", LOW).alias("a")).agg(F.max("count").alias("most"))
    marked = counts.withColumn("a", F.shiftright("pair", LOW)).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = questions.select("chunk", "pair").join(marked, "pair")

    def run(own: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        answer = answer.sort_values("pair")
        known, count, is_best = (answer[c].to_numpy() for c in ("pair", "count", "best"))
        out = []
        for row in own.itertuples():
            per_text = np.asarray(row.links)
            rank, times = _ranks(from_planes(row.ranks), per_text), from_planes(row.times)
            at = np.searchsorted(known, from_planes(row.pairs))[rank]
            of_text = np.repeat(np.arange(len(per_text)), per_text)
            total, hits = np.zeros(len(per_text), np.int64), np.zeros(len(per_text), np.int64)
            np.add.at(total, of_text, times * count[at])
            np.add.at(hits, of_text, times * is_best[at])
            out.append(pd.DataFrame({"digest": row.digest, "n": row.n, **{c: getattr(row, c) for c in COUNTS}, "groups_sha256": row.groups_sha256, "n_best": hits, "count_sum": total}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("digest", "n", *COUNTS, "groups_sha256", "n_best", "count_sum")})

    kinds = "digest binary, n long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, n_best long, count_sum long"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, kinds)


def align(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    named = written(docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "named")
    found = written(measures(docs), "measures")
    total = docs.count()
    heavy = found.where(F.col("n") * HEAVY > total).drop("n")  # under HEAVY rows
    light = found.where(F.col("n") * HEAVY <= total).drop("n")
    some = named.where("digest is not null")
    joined = some.join(F.broadcast(heavy), "digest").unionByName(some.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest", "left"))
    numbers = [*COUNTS, "n_best", "count_sum"]
    none = named.where("digest is null").select("doc_id", *[F.lit(None).cast("long").alias(c) for c in numbers], F.lit(None).cast("string").alias("groups_sha256"))
    return joined.select("doc_id", *numbers, "groups_sha256").unionByName(none).na.fill(0, numbers).na.fill("", ["groups_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
