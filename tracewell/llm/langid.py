"""Language identification by cross-parsing entropy over suffix automata.

For every language the labelled text of a bounded sample is turned into a suffix automaton,
which recognises exactly the substrings of that text. A document is then parsed greedily into
phrases, each the longest match in the automaton from where the last one ended (a symbol the
language lacks is a phrase of its own). Cross-parsing entropy per symbol is
phrases * log2(sample size) / symbols; the language with the lowest value wins.

Symbols are the letters of the lower-cased text; each run of other characters is one blank.
Whole texts are parsed. Long ones are cut into pieces of ``PIECE`` symbols that run in parallel as lanes
of NumPy arrays, each as if a phrase began there; then the true parse is carried over every cut until it
meets a phrase that the piece has as well, from where on both are the same. So phrases do not end at
cuts. No shuffle takes place; the automata are broadcast.

Transitions of the commonest letters are a table, of at most ``TABLE`` entries for all languages together;
those of the other letters of the samples are sorted keys. No letter is left out of a sample.

Bounds of the fit (the prediction itself has none): per language at most ``SAMPLE_DOCS``
documents in the order of a hash of their id, of which whole texts are taken while at most
``SAMPLE_CHARS`` characters are used, fewer where there are so many languages that all samples together
would pass ``ALL_CHARS`` (if none fits, the start of the first). Only these texts come to the driver.

Defined results: a text that is null or has no letter gets ``und`` and score 0; ties go to the
smaller name; with one language learned the score is 1, with none all rows get ``und``; rows
with null lang, id or text are never learned from; repeated rows are predicted one by one;
columns of the input other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.bytesops import trim

SAMPLE_DOCS = 64
SAMPLE_CHARS = 24_000
ALL_CHARS = 4_000_000
SYMBOLS = 255
TABLE = 1 << 26
PIECE = 2048
UNKNOWN = "und"


def held_out() -> F.Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def collapse(text: str) -> str:
    out = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in out:
        out = out.replace("  ", " ")
    return out


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all substrings of ``text``; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Model:
    """Automata of all languages in one transition table.

    Row 0 is 'no transition'. Each language has a row without transitions (a phrase of one
    unknown symbol has ended there, as before the first symbol) and then its automaton. Symbols are
    0 (blank), 1.. by falling frequency, and one without transitions for letters of no sample.
    """

    def __init__(self, samples: dict[str, str], table: int = TABLE):
        self.langs = sorted(k for k, v in samples.items() if v.strip())
        texts = {k: collapse(samples[k]) for k in self.langs}
        common = Counter("".join(texts.values()).replace(" ", ""))
        ordered = sorted(common, key=lambda c: (-common[c], c))
        self.alphabet = {c: i + 1 for i, c in enumerate(ordered)}
        self.other = len(ordered) + 1
        automata = [suffix_automaton([0 if c == " " else self.alphabet[c] for c in texts[k]]) for k in self.langs]
        states = 1 + sum(len(go) + 1 for go in automata)
        self.width = max(1, min(len(ordered) + 1, SYMBOLS, table // states))
        dense = np.zeros((states, self.width), np.int32)
        first, self.empty, self.start, keys, goals = 1, [], [], [], []
        for go in automata:
            self.empty.append(first)
            self.start.append(first + 1)
            for s, moves in enumerate(go):
                for c, t in moves.items():
                    if c < self.width:
                        dense[first + 1 + s, c] = first + 1 + t
                    else:
                        keys.append((first + 1 + s) * (self.other + 1) + c)
                        goals.append(first + 1 + t)
            first += len(go) + 1
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.goals = np.array(keys, np.int64)[order], np.array(goals, np.int32)[order]
        self.table = dense.ravel()
        self.weight = np.array([np.log2(max(2, len(texts[k]))) for k in self.langs])
        self.empty, self.start = (np.array(x, np.int32)[:, None] for x in (self.empty, self.start))
        first = dense[self.start[:, 0]]
        self.again = np.where(first == 0, self.empty, first).astype(np.int32).reshape(len(self.langs), self.width)
        self._codes = None

    def codes(self) -> np.ndarray:
        """Symbol of every code point; -1 stands for a non-letter."""
        if self._codes is None:
            out = np.fromiter((self.other if chr(i).isalpha() else -1 for i in range(0x110000)), np.int32, 0x110000)
            for c, i in self.alphabet.items():
                out[ord(c)] = i
            self._codes = out
        return self._codes

    def __getstate__(self):
        return self.__dict__ | {"_codes": None}

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts, their number in each text, whether it has a letter."""
        low = [t.lower() for t in texts]
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.codes()[points]
        sizes = np.array([len(t) for t in low], np.int64)
        row = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        blank = s < 0
        keep = np.ones(len(s), bool)
        keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
        letters = np.bincount(row[~blank], minlength=len(low)) > 0
        s = np.maximum(s[keep], 0)
        return s, np.bincount(row[keep], minlength=len(low)), letters

    def by_key(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states for letters that are not in the table; 0 where there is none."""
        if not len(self.keys):
            return np.zeros(state.shape, np.int32)
        key = state.astype(np.int64) * (self.other + 1) + c
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.goals[k], 0).astype(np.int32)

    def move(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state of every lane (languages x lanes) after its symbol, and whether the symbol begins a phrase."""
        rare = np.flatnonzero(c >= self.width)
        known = c if not len(rare) else np.where(c >= self.width, 0, c)
        after = self.table[state * np.int32(self.width) + known]
        if len(rare):
            after[:, rare] = self.by_key(state[:, rare], c[rare])
        new = after == 0
        again = self.again[:, known]
        if len(rare):
            first = self.by_key(np.broadcast_to(self.start, (len(self.langs), len(rare))), c[rare])
            again[:, rare] = np.where(first == 0, self.empty, first)
        np.copyto(after, again, where=new)
        return after, new

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of every text in every language (languages x texts)."""
        start, length, owner = pieces(sizes)
        order = np.argsort(-length, kind="stable")
        lanes, n = start[order], length[order]
        begins = np.zeros((len(self.langs), len(symbols)), bool)
        state = np.broadcast_to(self.empty, (len(self.langs), len(start))).copy()
        live = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
        for t, k in enumerate(live):
            state[:, :k], begins[:, lanes[:k] + t] = self.move(state[:, :k], symbols[lanes[:k] + t])
        end = np.empty_like(state)
        end[:, order] = state
        out = np.zeros((len(self.langs), len(sizes)), np.int64)
        filled = np.flatnonzero(sizes)
        if len(filled):
            # += : texts without symbols keep 0
            out[:, filled] = np.add.reduceat(begins, (np.cumsum(sizes) - sizes)[filled], axis=1, dtype=np.int64)
        self._carry(symbols, begins, start, length, owner, end, out)
        return out

    def _carry(self, symbols, begins, start, length, owner, guess, out) -> None:
        """Corrects ``out`` for phrases that run over cuts.

        All pieces go on from the end (``guess``) of the one before at once; those that never meet their own parse
        have another end, so the pieces after them are done again.
        """
        end = guess.copy()
        more = np.zeros(guess.shape, np.int64)
        todo = np.flatnonzero(np.diff(owner, prepend=-1) == 0)
        while len(todo):
            state = end[:, todo - 1]
            more[:, todo] = 0
            apart = np.ones(state.shape, bool)  # the parse has not met the piece's own yet
            lanes = np.arange(len(todo))
            for t in range(PIECE):
                lanes = lanes[(length[todo[lanes]] > t) & apart[:, lanes].any(0)]
                if not len(lanes):
                    break
                where = start[todo[lanes]] + t
                after, new = self.move(state[:, lanes], symbols[where])
                state[:, lanes] = after
                own, still = begins[:, where], apart[:, lanes]
                more[:, todo[lanes]] += still * (new.astype(np.int8) - own.astype(np.int8))
                apart[:, lanes] = still & ~(new & own)
            now = np.where(apart, state, guess[:, todo])
            changed = todo[(now != end[:, todo]).any(0)]
            end[:, todo] = now
            todo = changed[changed + 1 < len(owner)] + 1
            todo = todo[owner[todo] == owner[todo - 1]]
        for i in range(len(self.langs)):
            out[i] += np.bincount(owner, weights=more[i], minlength=out.shape[1]).astype(np.int64)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        symbols, sizes, letters = self.symbols(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cost = self.phrases(symbols, sizes) * self.weight[:, None]
        best = cost.argmin(0)
        ordered = np.sort(cost, 0)
        if len(self.langs) > 1:
            score = 1 - ordered[0] / np.maximum(ordered[1], 1e-9)
        else:
            score = np.ones(len(texts))
        score[~letters] = 0
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score


def pieces(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of the pieces of at most PIECE symbols."""
    n = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(sizes) - sizes
    start = base[owner] + k * PIECE
    return start, np.minimum(PIECE, (base + sizes)[owner] - start), owner


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, all_chars: int = ALL_CHARS) -> Model:
    """Learn from rows with a language that are not held out; see the module for the bounds."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    key = ["lang", "order", "doc_id", "text_hash"]
    keyed = rows.select("lang", F.xxhash64("doc_id", F.lit("sample")).alias("order"), "doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("size"), "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "text_hash"))
    ranked = keyed.select(*key, "size").withColumn("rank", place)
    chosen = ranked.filter(F.col("rank") <= sample_docs).collect()  # Spark limits each group before it shuffles
    langs: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["rank"])):
        langs.setdefault(r["lang"], []).append(r)
    room = min(sample_chars, all_chars // max(1, len(langs)))
    wanted, seen = [], set()
    for own in langs.values():
        left = room
        for r in own:
            k = tuple(r[c] for c in key)
            if r["size"] < left and k not in seen:  # a repeated row is taken once
                seen.add(k)
                wanted.append((*k, r["size"]))
                left -= r["size"] + 1
        if left == room:
            wanted.append((*(own[0][c] for c in key), room))
    samples: dict[str, list[tuple]] = {}
    if wanted:
        kinds = dict(keyed.dtypes)
        keys = docs.sparkSession.createDataFrame(wanted, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", take long")
        found = keyed.select(*key, "text").join(F.broadcast(keys), key).groupBy(*key).agg(F.first(F.expr("substring(text, 1, int(take))")).alias("text"))
        for r in found.collect():
            samples.setdefault(r["lang"], []).append((r["order"], r["doc_id"], r["text"]))
    return Model({lang: " ".join(t for _, _, t in sorted(own)) for lang, own in samples.items()})


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the columns __lang and __score, which replace any of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("__lang", "__score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pred: list[str] = []
            score: list[np.ndarray] = [np.zeros(0)]
            i = 0
            room_of = max(1 << 16, (6 << 20) // max(1, len(shared.value.langs)))
            while i < len(texts):
                j, room = i, room_of
                while j < len(texts) and (j == i or room >= len(texts[j])):
                    room -= len(texts[j])
                    j += 1
                p, s = shared.value.predict(texts[i:j])
                pred += p
                score.append(s)
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.concatenate(score))], names=[*batch.schema.names, "__lang", "__score"])
            trim()

    extra = docs.select("*", F.lit("").alias("__lang"), F.lit(0.0).alias("__score")).schema
    return docs.mapInArrow(run, extra)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    rows = labelled(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns as they are; ``und`` is rejected."""
    clash = {c: f"__kept{c}" for c in ("__lang", "__score") if c in docs.columns}
    kept = labelled(docs.withColumnsRenamed(clash), fit(docs)).filter(F.col("__lang") != UNKNOWN).drop("__lang", "__score")
    return kept.withColumnsRenamed({v: k for k, v in clash.items()})


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
