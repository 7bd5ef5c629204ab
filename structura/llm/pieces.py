"""A unigram piece vocabulary read from a public tokenizer file.

The file's pieces and scores are taken as they are; nothing is trained.
A unigram file's scores are log-probabilities.  A BPE file scores a piece
by minus its merge rank, which says only how common the piece is among
the others; ranks are turned into log-probabilities by Zipf's law.  Pieces
begin with the word mark or hold none; the mark inside a text is spelled
in bytes, so decoding is exact.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

MARK = "▁"
VOCABULARY = os.environ.get("STRUCTURA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Zipf-Mandelbrot offset for merge ranks.
RANK_OFFSET = 2.7


@dataclass(frozen=True)
class Vocabulary:
    """``steps``: every prefix of a piece -> the piece's log-probability, or None where no piece ends."""

    steps: dict[str, float | None]
    ids: dict[str, int]
    names: list[str]
    byte_logp: list[float]
    byte_ids: list[int]
    end_logp: float
    start_logp: float

    def spelled(self, char: str) -> float:
        """Log-probability of a character spelled in byte pieces."""
        return sum(self.byte_logp[b] for b in char.encode("utf-8", "surrogatepass"))

    def edges(self, token: str) -> list[list[tuple[int, float]]]:
        """For every end position the ``(start, log-probability)`` of the pieces that end there.

        ``token`` begins with the word mark.  A character that is no piece
        by itself is also spelled in bytes, so every position is reached.
        """
        steps, n = self.steps, len(token)
        out: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        get = steps.get
        for i in range(n):
            if i and token[i] == MARK:
                out[i + 1].append((i, self.spelled(MARK)))
                continue
            j, single = i + 1, False
            while j <= n:
                p = get(token[i:j], 0.0)
                if p == 0.0:
                    break
                if p is not None:
                    out[j].append((i, p))
                    single = single or j == i + 1
                j += 1
            if not single:
                out[i + 1].append((i, self.spelled(token[i])))
        return out

    def marginal(self, token: str) -> float:
        """Log of the summed probability of all segmentations of ``token`` (forward recursion)."""
        steps, n = self.steps, len(token)
        get, exp, log1p = steps.get, math.exp, math.log1p
        low = -math.inf
        alpha = [low] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            j, single = i + 1, False
            if not i or token[i] != MARK:
                while j <= n:
                    p = get(token[i:j], 0.0)
                    if p == 0.0:
                        break
                    if p is not None:
                        x, y = alpha[j], a + p
                        if x == low:
                            alpha[j] = y
                        elif x > y:
                            alpha[j] = x + log1p(exp(y - x))
                        else:
                            alpha[j] = y + log1p(exp(x - y))
                        single = single or j == i + 1
                    j += 1
            if not single:
                x, y = alpha[i + 1], a + self.spelled(token[i])
                alpha[i + 1] = y if x == low else max(x, y) + log1p(exp(min(x, y) - max(x, y)))
        return alpha[n]


def from_scores(pieces: list[tuple[str, float, int]], byte_pieces: list[tuple[float, int]], end: float,
                names: list[str]) -> Vocabulary:
    """Vocabulary of ``(piece, log weight, id)`` and 256 byte pieces; weights are normalised to sum to one."""
    every = [w for _, w, _ in pieces] + [w for w, _ in byte_pieces] + [end]
    top = max(every)
    total = top + math.log(sum(math.exp(w - top) for w in every))
    steps: dict[str, float | None] = {}
    start = 0.0
    for piece, weight, _ in pieces:
        for j in range(1, len(piece)):
            steps.setdefault(piece[:j], None)
    for piece, weight, _ in pieces:
        # 0.0 means absent in the tables above, so a certain piece is only nearly certain
        steps[piece] = min(weight - total, -1e-12)
        if piece.startswith(MARK):
            start += math.exp(weight - total)
    return Vocabulary(steps, {p: i for p, _, i in pieces}, names, [w - total for w, _ in byte_pieces],
                      [i for _, i in byte_pieces], end - total, math.log(start + math.exp(end - total)))


def load(path: str = VOCABULARY) -> Vocabulary:
    """Read a SentencePiece model file on the driver (its size is that of the file, whatever the data)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
             and names[i] and MARK not in names[i][1:]]
    scores = {i: model.get_score(i) for i in plain}
    ranked = all(s <= 0 and s == int(s) for s in scores.values())
    lowest = min(scores.values())
    if ranked:
        def weight(s: float) -> float:
            return -math.log(RANK_OFFSET - s)
    else:
        def weight(s: float) -> float:
            return s
    if MARK not in names:
        names.append(MARK)
        scores[size] = lowest
        plain.append(size)
    pieces = [(names[i], weight(scores[i]), i) for i in plain]
    of_byte = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
    if len(of_byte) < 256:  # a file without byte pieces gets them after its own
        of_byte = {b: len(names) + b for b in range(256)}
        names = names + [f"<0x{b:02X}>" for b in range(256)]
    return from_scores(pieces, [(weight(lowest), of_byte[b]) for b in range(256)], weight(max(scores.values())), names)
