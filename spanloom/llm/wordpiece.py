"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary entry at each place; the first piece of a word comes
from one set of entries, later pieces from another. A trie over the vocabulary, with failure links, does this in
one pass over a word: when no edge goes on, the link leads to the place that the text has after the longest
pieces are popped, and says how many these are. Only their number is kept, so no piece is ever built.

Words are runs of letters and digits, of any length; any other character but white space is a word. A word that
cannot be split is one unknown token. Counts of words met before come from a bounded table, which holds words of
up to LONGEST characters; longer ones are counted anew in each text.

The vocabulary is that of a sentencepiece model file: entries that begin with its space mark start a word, the
others go on with one; control, unknown and byte entries are left out.

Defined results: a null or blank text has no words and no tokens; rows are counted each; all columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, table

MARK = "▁"
LONGEST = 100
MEMO = 500_000
WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


class Automaton:
    """count(word): the number of greedy longest-match pieces, 0 if the word cannot be split."""

    def __init__(self, first: Iterable[str], later: Iterable[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]  # node 0 starts a word, node 1 a later piece
        self.piece = [False, False]
        for root, entries in ((0, first), (1, later)):
            for entry in entries:
                node = root
                for ch in entry:
                    if ch not in self.next[node]:
                        self.next[node][ch] = len(self.next)
                        self.next.append({})
                        self.piece.append(False)
                    node = self.next[node][ch]
                self.piece[node] = True
        self._link()

    def _link(self) -> None:
        """fail[v]: where the text of v stands after its longest pieces are popped, -1 if it cannot; popped[v]: their number."""
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = [0, 1]
        for node in queue:
            for ch, child in self.next[node].items():
                if self.piece[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    at, popped = self.fail[node], self.popped[node]
                    while at >= 0 and ch not in self.next[at]:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.next[at][ch], popped
                queue.append(child)

    def count(self, word: str) -> int:
        node, pieces = 0, 0
        for ch in word:
            while ch not in self.next[node]:
                pieces += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return 0
            node = self.next[node][ch]
        while node > 1:  # pop what is left; node 1 is the empty rest
            pieces += self.popped[node]
            node = self.fail[node]
        return pieces if node == 1 else 0


@lru_cache(1)
def load(path: str) -> Automaton:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    return Automaton([p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1], [p for p in pieces if not p.startswith(MARK)])


class Counter:
    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.known = automaton, {}

    def __call__(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens, unknown tokens."""
        words, known = WORD.findall(text or ""), self.known
        if len(known) > MEMO:
            known.clear()
        long = {}
        for w in set(words).difference(known):
            (known if len(w) <= LONGEST else long)[w] = self.automaton.count(w)
        counts = [long[w] if w in long else known[w] for w in words] if long else list(map(known.__getitem__, words))
        unknown = counts.count(0)
        return len(words), sum(counts) + unknown, unknown


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "count") -> DataFrame:
    """docs with ``out``: struct(n_words, n_tokens, n_unknown) of longs."""
    path = model or default_model()
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_words long, n_tokens long, n_unknown long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(load(path))
        for texts in batches:
            yield pd.DataFrame([counter(t) for t in texts], columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")

    (name,) = fresh(docs, out)
    df = docs.withColumn(name, counted(F.col(text)))
    return df if name == out else df.withColumnRenamed(name, out)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "count.*")
