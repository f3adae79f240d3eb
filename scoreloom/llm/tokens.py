"""Token counts by trie-shared dynamic programming over distinct pre-tokens (operator 9)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import bytescan as B

#: Vocabulary whose pieces the unigram model has.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the pre-tokens whose counts a worker keeps before it starts anew.
KEPT = 4_000_000
#: Characters from which on a pre-token is read on its own, with a window of its last positions instead of the path of them all.
LONG = 1 << 14
#: Bytes of texts whose pre-tokens are counted together.
CHUNK = 1 << 19
_SPACE = "▁"


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces with unigram scores: minus the log of the rank from 1, Zipf's law for a vocabulary ordered by frequency.

    The vocabulary file has ranks only, and tokenizers are not trained here.
    Byte and control pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank) for rank, i in enumerate(normal, 1)}


class Unigram:
    """Piece counts of the best segmentation of pre-tokens."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.longest = max(map(len, pieces), default=1)
        self.children: list[dict[str, int]] = [{}]
        self.score: list[float | None] = [None]
        for piece, score in pieces.items():
            node = 0
            for c in piece:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.score.append(None)
            self.score[node] = score

    def counts(self, tokens: Iterable[str]) -> dict[str, int]:
        """Terminal counts of distinct ``tokens``.

        In sorted order the tokens are the trie's nodes depth first; the lists
        below are the path from the root. A prefix that several tokens share is
        on the path once, and so are its forward scores. The best way to each
        position is the first of the highest score; a character that is no
        piece costs ``unknown`` and counts as its UTF-8 bytes.
        """
        children, value, unknown = self.children, self.score, self.unknown
        out: dict[str, int] = {}
        best, pieces, open_ = [0.0], [0], [[]]
        before = ""
        for token in sorted(tokens):
            if len(token) > LONG:
                out[token] = self._long(token)
                continue
            shared, most = 0, min(len(before), len(token))
            while shared < most and before[shared] == token[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :], open_[shared + 1 :]
            for at in range(shared, len(token)):
                c = token[at]
                top, count, live, single = None, 0, [], False
                for node, start in (*open_[at], (0, at)):
                    node = children[node].get(c)
                    if node is None:
                        continue
                    live.append((node, start))
                    score = value[node]
                    if score is not None:
                        single |= start == at
                        total = best[start] + score
                        if top is None or total > top:
                            top, count = total, pieces[start] + 1
                if not single and (top is None or best[at] + unknown > top):
                    top, count = best[at] + unknown, pieces[at] + len(c.encode())
                best.append(top)
                pieces.append(count)
                open_.append(live)
            out[token] = pieces[len(token)]
            before = token
        return out

    def _long(self, token: str) -> int:
        """The count of one pre-token by the same steps; positions that no piece reaches back to are forgotten."""
        best, pieces, live, base = [0.0], [0], [], 0
        for at, c in enumerate(token):
            top, count, now, single = None, 0, [], False
            for node, start in (*live, (0, at)):
                node = self.children[node].get(c)
                if node is None:
                    continue
                now.append((node, start))
                score = self.score[node]
                if score is not None:
                    single |= start == at
                    total = best[start - base] + score
                    if top is None or total > top:
                        top, count = total, pieces[start - base] + 1
            if not single and (top is None or best[-1] + self.unknown > top):
                top, count = best[-1] + self.unknown, pieces[-1] + len(c.encode())
            best.append(top)
            pieces.append(count)
            live = now
            if len(best) > 4 * self.longest + 64:
                gone = len(best) - self.longest - 1
                del best[:gone], pieces[:gone]
                base += gone
        return pieces[-1]


def pre_tokens(text: str) -> list[str]:
    """Parts that each begin with the visible space; a text is read as if a space came before it.

    The visible space itself counts as a space.
    """
    parts = text.replace(_SPACE, " ").split(" ")
    return [_SPACE + p for p in (parts[1:] if parts[0] == "" else parts)] if text else []


def token_counts(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_pre_tokens)`` for each row of ``docs``.

    The new distinct pre-tokens of texts of ``CHUNK`` bytes, or of one longer
    text, go through one trie and their counts are kept for later texts of the
    task, up to ``KEPT`` characters; nothing is shuffled or broadcast but the vocabulary. Nulls and empty texts have 0
    tokens; ids may be null and repeat; an empty table gives no rows; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, kept = Unigram(pieces), {}, 0
        for batch in batches:
            tokens, parts = [], []
            column = batch.column(1)
            for lo, _, offsets in B.chunks(column, CHUNK):
                texts = [pre_tokens(t or "") for t in column.slice(lo, len(offsets) - 1).to_pylist()]
                if kept > KEPT:
                    known, kept = {}, 0
                new = set().union(*texts).difference(known)
                kept += sum(map(len, new))
                known.update(model.counts(new))
                tokens += [sum(map(known.__getitem__, t)) for t in texts]
                parts += map(len, texts)
            yield pa.record_batch([batch.column(0), pa.array(tokens, pa.int64()), pa.array(parts, pa.int64())], ["doc_id", "n_tokens", "n_pre_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_pre_tokens long")
