"""Language-model scores of documents by a weighted backoff automaton over word n-grams.

Counts of all n-grams of the training texts are gathered by string, however many there are. Of a block of
documents only the n-grams that occur in it can be visited, so each block gets their counts and builds
its part of the automaton: a state for each known history, an arc for each known n-gram, weighted by its
smoothed log-probability, and from each state a failure arc to its suffix, weighted by the backoff mass.
Every text is one walk from left to right.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.llm.blocks import START, Block, Shard, code, entries, pack, shards_for
from verity.llm.common import Scratch, cut

#: Pseudo-counts that a history takes from its suffix (a Dirichlet prior), by the words of the history;
#: the last one holds for all longer ones. The held-out texts of sf0.01 are likeliest near these.
PRIOR = (50.0, 3.0)


def words(text: bytes) -> list[bytes]:
    """Lower-cased A-Z; bytes split at 0x20 and 0x09-0x0D."""
    return text.lower().split()


def _counter(frame: pd.DataFrame) -> pd.DataFrame:
    """The counts of every entry of a shard's rows, and of its words: how many tokens and different ones."""
    shard = Shard(frame)
    total = shard.total(frame["counts"].tolist(), [True] * len(frame))
    rows = [(block, own, pack(total[at], "<i8"), None, None) for block, own, at in zip(frame["block"], frame["shard"], shard.rows, strict=True)]
    single = np.fromiter((b" " not in s and s != START for s in shard.strings), dtype=bool, count=len(shard.strings))
    rows.append((None, None, None, int(total[single].sum()), int((total[single] > 0).sum())))
    return pd.DataFrame(rows, columns=["block", "shard", "told", "tokens", "types"]).astype({"block": "Int64", "shard": "Int32", "tokens": "Int64", "types": "Int64"})


class Automaton:
    """The part of the automaton that a block's texts can visit. ``counts``: of each n-gram, in the order
    of ``levels``; ``tokens`` and ``types`` of the training texts.

    States are the known n-grams of fewer than ``order`` words and the empty one. Of every n-gram it has
    the weight of its arc (from the state of its words but the last; NaN if it is none) and, for a state,
    the weight of its failure arc to the state of its words but the first. All parts of a known n-gram
    are known, so a state is told by how many of the last words it holds, and an arc by the n-gram that
    ends with the next word.
    """

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], counts: np.ndarray, size: int, tokens: int, types: int, prior: tuple[float, ...]):
        begin = np.concatenate([[0], np.cumsum([len(head) for _, head, _ in found])])
        count = [counts[a:b].astype(np.float64) for a, b in zip(begin, begin[1:], strict=False)]
        self.found, self.order = found, len(found)
        self.base = np.log10((count[0] + 0.5) / (tokens + 0.5 * (types + 1))) if size else np.zeros(0)
        self.known = count[0] > 0
        self.arcs, self.fails = [self.base], []
        chance = 10.0**self.base
        for k in range(1, self.order):
            at, head, _ = found[k]
            suffix = np.zeros(len(head), dtype=np.int64)  # the n-gram without its first word
            suffix[at[at >= 0]] = found[k - 1][0][at >= 0]
            mass, history = prior[min(k - 1, len(prior) - 1)], count[k - 1]
            self.fails.append(np.log10(mass / (history + mass)))
            own = history[head]
            chance = np.where(own > 0, (count[k] + mass * chance[suffix]) / (own + mass), chance[suffix])
            self.arcs.append(np.where(count[k] > 0, np.log10(chance), np.nan))

    def along(self) -> tuple[list[list[float]], list[list[float]], list[bool]]:
        """Place by place, by the number of words of the state before: the weight of the arc (NaN where
        there is none), that of the failure arc, and whether the word is known."""
        arcs, fails = [], []
        for k, (at, _, _) in enumerate(self.found):
            arcs.append(np.where(at >= 0, self.arcs[k][at], np.nan).tolist())
            if k + 1 < self.order:
                before = np.full(len(at), -1, dtype=np.int64)
                before[1:] = at[:-1]
                fails.append(np.where(before >= 0, self.fails[k][before], np.nan).tolist())
        return arcs, fails, self.known[self.found[0][0]].tolist()

    def walk(self, arcs: list[list[float]], fails: list[list[float]], known: list[bool], begin: int, end: int) -> float:
        """The log10-probability of the words at these places; the one at ``begin`` is START, which is
        no token but the first state. The state is carried from word to word."""
        top, total = self.order - 1, 0.0
        held = 1 if top and known[begin] else 0
        for at in range(begin + 1, end):
            weight = arcs[held][at]
            while weight != weight:  # no arc: to the state of one word less
                total += fails[held - 1][at]
                held -= 1
                weight = arcs[held][at]
            total += weight
            held = (held + 1 if held < top else top) if held or known[at] else 0
        return total


def _scorer(order: int, shards: int, tokens: int, types: int, prior: tuple[float, ...]):
    def score(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        block = Block(next(rows.itertuples()), order, shards)
        machine = Automaton(block.found, block.answers(told, "<i8"), len(block.words), tokens, types, prior)
        arcs, fails, known = machine.along()
        ends = np.cumsum(block.lengths)
        return pd.DataFrame(
            {
                "doc_id": pd.Series(block.ids, dtype=object), "learns": block.learns, "n_tokens": block.lengths - 1,
                "n_known": block.sums((machine.known[block.codes] & ~block.first).astype(np.int64)),
                "base_score": [float(machine.base[c[1:]].sum()) for c in block.coded()],
                "score": [machine.walk(arcs, fails, known, begin, end) for begin, end in zip((ends - block.lengths).tolist(), ends.tolist(), strict=True)],
            }
        )

    return score


def score_texts(docs: DataFrame, learns: str = "learns", order: int = 2, prior: tuple[float, ...] = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, learns, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words of the lower-cased text and one end. ``base_score`` adds up add-half unigram
    log10-probabilities of the texts with ``learns``; ``score`` is the log10-probability of the whole text
    in the backoff model of ``order`` words, whose shortest history is that unigram model.

    * A null or empty text is its end alone. Null ids stay null, a null ``learns`` is false. Rows that
      repeat are learned and scored each; equal texts have equal scores.
    * Where nothing is learned every token is unknown, and the scores are those of a model of no counts.
    """
    with Scratch(docs.sparkSession) as scratch:
        own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(learns).alias("learns"))
        shards = shards_for(own)
        blocks = scratch.cut(code(own, words, marks=True), "backoff-blocks")
        merged = scratch.cut(entries(blocks, order, shards).groupBy("shard").applyInPandas(_counter, "block long, shard int, told binary, tokens long, types long"), "backoff-counts")
        sums = merged.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
        told = merged.where("block is not null").select("block", "shard", "told")
        kind = docs.schema[id_col].dataType.simpleString()
        scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(
            _scorer(order, shards, sums["tokens"], sums["types"], prior), "doc_id string, learns boolean, n_tokens long, n_known long, base_score double, score double"
        )
        return cut(scored.select(F.col("doc_id").cast(kind).alias("doc_id"), "learns", "n_tokens", "n_known", F.lit(sums["tokens"]).cast("long").alias("train_tokens"), "base_score", "score"), "backoff-scores")
