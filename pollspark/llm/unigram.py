"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The pieces and scores are those of a public vocabulary file. Spaces become the
word mark, and each marked word is segmented on its own. Aho-Corasick enumerates all
pieces inside a word by end position; dynamic programming carries, for each end, the
best score and what is needed to count pieces, never the segmentation itself.

Tie rules are the tokenizer's: among equal scores the candidate with the earliest
start, the longest piece, stays; an unknown character scores ten below the worst
piece and is tried after the pieces that start with it, unless one is that
character alone. Runs of unknown characters are joined: one unknown piece, or one
piece per byte where the vocabulary has byte pieces.

A task remembers the counts of words it has met (bounded), so that common words are
searched once.

Cases: a null or empty text has no pieces and score 0; repeated rows are counted
each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from pollspark.llm.common import map_batches, table, texts

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words a task remembers and the longest one worth it; both change speed only.
MEMO, LONGEST = 500_000, 32


def load_pieces(path: str | None = None) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores in id order, and the unknown piece's id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class CountViterbi:
    """``count(text)`` gives the number of pieces, the unknown ones among them, and the score."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, memo: int = MEMO):
        self.automaton = ahocorasick.Automaton()
        known = {}
        for piece, score in pieces:
            if piece:
                known[piece] = score
        for piece, score in known.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.singles = frozenset(p for p in known if len(p) == 1)
        #: With byte pieces, a line feed that no piece holds is one byte wherever it stands, so words end there.
        self.feeds = self.bytes and not any("\n" in p for p in known)
        self.memo: dict[str, tuple[int, int, float]] = {}
        self.limit = memo

    def word(self, word: str) -> tuple[int, int, float]:
        """Search one word. Matches come by end, longest first."""
        if not self.singles.issuperset(word):
            return self._with_unknown(word)
        score: list[float | None] = [0.0] + [None] * len(word)
        count = [0] * (len(word) + 1)
        for end, (length, value) in self.automaton.iter(word):
            end += 1
            candidate = score[end - length] + value
            best = score[end]
            if best is None or candidate > best:
                score[end] = candidate
                count[end] = count[end - length] + 1
        return count[-1], 0, score[-1]

    def _with_unknown(self, word: str) -> tuple[int, int, float]:
        """Search a word with characters that are no piece.

        State per end: best score, the pieces and the unknown ones so far, and where an
        unknown run that is still open began.
        """
        n = len(word)
        score = [0.0] * (n + 1)
        count, unknown = [0] * (n + 1), [0] * (n + 1)
        run = [-1] * (n + 1)  # first character of the unknown run that ends here
        reached = [True] + [False] * n
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, value) in self.automaton.iter(word):
            ends[end].append((length, value))
        for end in range(n):
            best, start, single = None, -1, False
            for length, value in ends[end]:
                begin = end + 1 - length
                single = single or length == 1
                if reached[begin]:
                    candidate = score[begin] + value
                    if best is None or candidate > best:
                        best, start = candidate, begin
            if not single and reached[end]:
                candidate = score[end] + self.unknown
                if best is None or candidate > best:
                    best, start = candidate, -1
            if best is None:
                continue
            here = end + 1
            reached[here], score[here] = True, best
            if start >= 0:
                count[here], unknown[here] = self._closed(word, start, count, unknown, run)
                count[here] += 1
            else:
                run[here] = run[end] if run[end] >= 0 else end
                count[here], unknown[here] = count[end], unknown[end]
        pieces, lost = self._closed(word, n, count, unknown, run)
        return pieces, lost, score[n]

    def _closed(self, word: str, at: int, count: list[int], unknown: list[int], run: list[int]) -> tuple[int, int]:
        """Counts up to ``at`` with the unknown run that ends there, if any, turned into pieces."""
        if run[at] < 0:
            return count[at], unknown[at]
        made = len(word[run[at] : at].encode("utf-8", "surrogatepass")) if self.bytes else 1
        return count[at] + made, unknown[at] + made

    def counts(self, values: list[str]) -> list[tuple[int, int, float]]:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        split, feeds = [], []
        for text in values:
            if MARK in text:
                text = text.replace(MARK, " ")
            # A text that starts with a space has its mark already; an empty one has none.
            text = text[1:] if text[:1] == " " else text or None
            feeds.append(text.count("\n") if self.feeds and text else 0)
            if feeds[-1]:
                text = text.replace("\n", " \n")
            split.append([] if text is None else text.split(" "))
        fresh = set().union(*split).difference(memo)
        for part in fresh:
            memo[part] = self.word(part[1:] if self.feeds and part[:1] == "\n" else MARK + part)
        out = []
        for parts, fed in zip(split, feeds, strict=True):
            found = list(map(memo.__getitem__, parts))
            n, lost, score = map(sum, zip(*found, strict=True)) if found else (0, 0, 0.0)
            out.append((n + fed, lost + fed, score + fed * self.unknown))
        for part in fresh:
            if len(part) > LONGEST:
                del memo[part]
        return out


@lru_cache(maxsize=2)
def counter(path: str | None) -> CountViterbi:
    """One per Python worker and vocabulary."""
    return CountViterbi(load_pieces(path)[0])


def count_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_pieces, n_unknown, score)`` of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = counter(path).counts(batch.column(1).to_pylist())
            columns = list(map(list, zip(*found, strict=True))) or [[], [], []]
            yield {"id": batch.column(0), "n": columns[0], "u": columns[1], "s": columns[2]}

    return map_batches(texts(docs, text_col, id_col), step, f"`{id_col}` {kind}, n_pieces long, n_unknown long, score double")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    return count_pieces(table(spark, sf_dir, "documents"))
