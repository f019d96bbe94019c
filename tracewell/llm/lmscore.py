"""Cross-entropy difference of two matched n-gram models (selection of text like a target).

The target model counts the documents labelled as good (quality 1, not toxic), the background
model all others. Both are bigram models over one shared vocabulary, all words of the corpus:

    P1(w)    = (c(w) + 1) / (N + V)
    P(w | v) = (c(v w) + MU * P1(w)) / (c(v) + MU)      v is the word before, or the start

with the same V and MU in both. A document's own tokens are left out of the model it
belongs to, so that labelled documents are not scored by themselves. For every token the loss
-ln P is taken in both models; score is the mean of the differences, target minus background:
the lower, the more like the target.

Counts cover all documents and words (hashed to 64 bits), without a cap. Blocks send their
distinct words and bigrams with counts, buckets add them up and answer (see ``blocks``), so the
commonest bigram arrives once per block. N and V are one row for all.

Defined results: null, empty and word-free texts have no tokens and null losses and score; null ids
have no label; a document is a target if some label row says quality 1 and none says toxic 1;
repeated rows are scored one by one (and are counted twice); empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import blocks as B
from tracewell.llm.bytesops import mix, packed, slices, text_buffers, unpacked, word_bounds, word_hashes

MU = 8.0
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
TOTALS = -2
_START = np.uint64(0x2545F4914F6CDD1D)
_ONE, _TWO = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD1342543DE82EF95)


class Scorer:
    def __init__(self, mu: float, n_buckets: int):
        self.mu, self.n = mu, n_buckets

    def load(self, rows: pa.Table):
        """Texts of the block, whether each is a target, and per token: row, word and bigram keys."""
        good = rows.column("good").combine_chunks()
        label = np.asarray(good.is_valid().to_numpy(zero_copy_only=False))
        ids = rows.column("doc_id").combine_chunks()
        marked = {i for i, g in zip(ids.filter(pa.array(label)).to_pylist(), good.filter(pa.array(label)).to_pylist(), strict=True) if g}
        docs = rows.filter(pa.array(~label))
        own = docs.column("doc_id").combine_chunks()
        target = np.fromiter((i in marked for i in own.to_pylist()), bool, docs.num_rows)
        data, offsets = text_buffers(docs.column("text"))
        words, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in slices(offsets):
            part = data[offsets[i] : offsets[j]]
            start, stop, row = word_bounds(part, offsets[i : j + 1] - offsets[i])
            words.append(word_hashes(part, start, stop))
            owner.append(row + i)
        w, row = np.concatenate(words), np.concatenate(owner)
        before = np.empty_like(w)
        before[1:] = w[:-1]
        first = np.ones(len(w), bool)
        first[1:] = row[1:] != row[:-1]
        before[first] = _START
        return own, target, row, mix(w ^ _ONE), mix(before ^ _ONE), mix(before * _TWO + w)

    def counted(self, rows: pa.Table):
        own, target, row, one, before, two = self.load(rows)
        # the start symbol is a context of its own: counted as a word here, left out of N and V
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        keys, at = np.unique(np.concatenate([one, two, before[heads]]), return_inverse=True)
        of = np.concatenate([row, row, row[heads]])
        good = np.bincount(at, weights=target[of], minlength=len(keys)).astype(np.int64)
        every = np.bincount(at, minlength=len(keys))
        n = len(row)
        word = np.zeros(len(keys), bool)
        word[at[:n]] = True
        return own, target, row, keys, at, good, every - good, word

    def ask(self, block, rows, _):
        _, _, _, keys, _, good, rest, word = self.counted(rows)
        flag = good << 1 | word  # the low bit: the key is a word
        return [(b, block, 0, packed(keys[s]), packed(flag[s]), packed(rest[s])) for b, s in B.split(keys, self.n)]

    def answer(self, got):
        if not got:
            return []
        keys = np.concatenate([unpacked(m[3]) for m in got])
        flag = np.concatenate([unpacked(m[4], np.int64) for m in got])
        rest = np.concatenate([unpacked(m[5], np.int64) for m in got])
        every, at = np.unique(keys, return_inverse=True)
        good, bad = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        np.add.at(good, at, flag >> 1)
        np.add.at(bad, at, rest)
        word = np.zeros(len(every), bool)
        word[at[flag & 1 == 1]] = True
        out, i = [], 0
        for bucket, block, _, a, _, _ in got:
            own = at[i : i + len(a) // 8]
            out.append((bucket, block, 1, None, packed(good[own]), packed(bad[own])))
            i += len(a) // 8
        total = np.array([good[word].sum(), bad[word].sum(), word.sum()], np.int64)
        return [*out, (got[0][0], -1, TOTALS, total.astype('>i8').tobytes(), None, None)]

    def score(self, rows, got) -> pa.Table:
        names = ["doc_id", "n_tokens", "ce_target", "ce_background", "score"]
        if rows is None:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.float64()] * 3)], names=names)
        own, target, row, keys, at, _, _, _ = self.counted(rows)
        counts = np.zeros((2, len(keys)), np.int64)
        replies = {m[0]: m for m in got if m[2] == 1}
        for b, s in B.split(keys, self.n):
            counts[0, s], counts[1, s] = unpacked(replies[b][4], np.int64), unpacked(replies[b][5], np.int64)
        totals = next((np.frombuffer(m[3], '>i8').astype(np.int64) for m in got if m[2] == TOTALS), np.zeros(3, np.int64))
        n = len(row)
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        one, two = at[:n], at[n : 2 * n]
        before = np.empty(n, np.int64)
        before[1:] = one[:-1]
        before[heads] = at[2 * n :]
        # counts of the same key in the same document, to leave out
        own_one, own_two = within(one, row, len(own)), within(two, row, len(own))
        own_before = np.ones(n, np.int64)
        own_before[1:] = own_one[:-1]
        own_before[heads] = 1
        tokens = np.bincount(row, minlength=len(own))
        loss = []
        for k in (0, 1):
            mine = (target if k == 0 else ~target)[row].astype(np.int64)
            total = totals[k] - mine * tokens[row]
            p1 = (counts[k][one] - mine * own_one + 1.0) / (total + float(totals[2]))
            p = (counts[k][two] - mine * own_two + self.mu * p1) / (counts[k][before] - mine * own_before + self.mu)
            loss.append(np.bincount(row, weights=-np.log(p), minlength=len(own)))
        none = tokens == 0
        mean = [x / np.maximum(tokens, 1) for x in loss]
        cols = [pa.array(x, mask=none) for x in (mean[0], mean[1], mean[0] - mean[1])]
        return pa.Table.from_arrays([own, pa.array(tokens.astype(np.int64)), *cols], names=names)


def within(key: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """How often each token's key occurs in its row."""
    _, at, n = np.unique(key.astype(np.int64) * n_rows + row, return_inverse=True, return_counts=True)
    return n[at]


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, mu: float = MU, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background and score of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    size = B.text_size(docs)
    n_blocks = max(1, -(-size // block_bytes))
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg((F.max(F.coalesce("quality", F.lit(0)) == 1) & ~F.max(F.coalesce("toxic", F.lit(0)) == 1)).alias("good"))
    rows = docs.withColumn("good", F.lit(None).cast("boolean")).unionByName(good.filter("good").select("doc_id", F.lit(None).cast("string").alias("text"), "good"))
    dealt = B.dealt(rows, n_blocks)
    s = Scorer(mu, max(1, -(-size // bucket_bytes)))
    answers = B.answer(B.ask(dealt, s.ask), s.answer)
    part = lambda k: F.sum(from_bytes(F.substring("a", 8 * k + 1, 8)))
    one = lambda c: F.pmod(F.xxhash64(c), F.lit(1)).alias("one")  # noqa: E731  the same key for all rows
    totals = answers.filter(F.col("kind") == TOTALS).groupBy(one("bucket")).agg(*(part(k).alias(f"t{k}") for k in range(3)))
    spread = docs.sparkSession.range(n_blocks).select(F.col("id").cast("int").alias("block"), one("id")).join(F.broadcast(totals), "one")  # one row
    packed_totals = F.concat(*(to_bytes(F.coalesce(f"t{k}", F.lit(0))) for k in range(3)))
    sent = spread.select(F.lit(0).alias("bucket"), "block", F.lit(TOTALS).alias("kind"), packed_totals.alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("c"))
    both = answers.filter(F.col("kind") != TOTALS).unionByName(sent)
    return B.finish(dealt, both, s.score, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")


def from_bytes(raw: F.Column) -> F.Column:
    """A long from its eight bytes, highest first."""
    return F.conv(F.hex(raw), 16, 10).cast("long")


def to_bytes(n: F.Column) -> F.Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the target is what ``labels`` calls good."""
    out = cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # sums in another order differ in the last digits
    return out.select("doc_id", "n_tokens", *(F.round(c, 8).alias(c) for c in ("ce_target", "ce_background", "score")))
