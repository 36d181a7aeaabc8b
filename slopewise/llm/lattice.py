"""Segmentations of words into the pieces of a public vocabulary, by recursion over a trie of the words.

Words come sorted, so that the path to the word before is the shared prefix of the next one: each node of the trie of
all words is worked out once. A word starts with the mark of a word's beginning. A character without a piece of its own
is spelled by its bytes.
"""

from __future__ import annotations

from math import exp, log

MARK = "▁"
NEVER = float("-inf")


class Pieces:
    """Pieces and their log scores. `score[piece]`; bytes have pieces `<0x00>` to `<0xFF>`."""

    def __init__(self, score: dict[str, float]):
        self.score = score
        self.tails = {p[k:] for p in score for k in range(len(p))}
        self.unknown = min(score.values()) - 10 if score else 0.0

    def spelled(self, char: str) -> list[str]:
        return [f"<0x{b:02X}>" for b in char.encode()]


def public_pieces(path: str) -> dict[str, float]:
    """Log scores of a public piece file: each piece's probability is in inverse proportion to its rank there."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    rank, last = {}, 0
    for k in range(file.get_piece_size()):
        if not (file.is_control(k) or file.is_unknown(k) or file.is_byte(k)) and file.get_score(k) > -1e8:
            rank[file.id_to_piece(k)] = -file.get_score(k)
            last = max(last, rank[file.id_to_piece(k)])
    rank |= {f"<0x{b:02X}>": last + 1 for b in range(256)}
    total = log(sum(1 / (r + 1) for r in rank.values()))
    return {p: -log(r + 1) - total for p, r in rank.items()}


def _shared(a: str, b: str) -> int:
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return k


def token_counts(pieces: Pieces, words: list[str]) -> list[int]:
    """For each word (sorted), the number of tokens of its best segmentation; an unknown character is as many tokens as it has bytes."""
    score, tails = pieces.score, pieces.tails
    best, tokens, out, before = [0.0], [0], [], ""
    for word in words:
        word = MARK + word
        keep = _shared(before, word)
        del best[keep + 1 :], tokens[keep + 1 :]
        for end in range(keep + 1, len(word) + 1):
            top, count, tail, k = NEVER, 0, "", end
            while k:
                k -= 1
                tail = word[k] + tail
                own = score.get(tail)
                if own is not None:
                    if best[k] + own > top:
                        top, count = best[k] + own, tokens[k] + 1
                elif k == end - 1:
                    top, count = best[k] + pieces.unknown, tokens[k] + len(tail.encode())
                    if tail not in tails:
                        break
                elif tail not in tails:
                    break
            best.append(top)
            tokens.append(count)
        out.append(tokens[-1])
        before = word
    return out


def log_totals(pieces: Pieces, words: list[str]) -> list[float]:
    """For each word (sorted), the log of the summed probability of all its segmentations, by forward recursion in log space."""
    forward, out, before = [0.0], [], ""
    for word in words:
        word = MARK + word
        keep = _shared(before, word)
        del forward[keep + 1 :]
        for end in range(keep + 1, len(word) + 1):
            forward.append(_sum([x for x, _, _ in _steps(pieces, word, end, forward)]))
        out.append(forward[-1])
        before = word
    return out


def expected_counts(pieces: Pieces, words: list[str]) -> dict[str, float]:
    """How often each piece is expected in one segmentation of every word (sorted), under the pieces' probabilities.

    Words pass their share back along the trie: a node gathers the shares of everything beneath it before it passes
    them on to the nodes its arcs come from, which all lie on its own path.
    """
    counts: dict[str, float] = {}
    forward, steps, share, before = [0.0], [()], [0.0], ""

    def leave(down_to: int) -> None:
        while len(forward) > down_to + 1:
            total, arcs, mass = forward.pop(), steps.pop(), share.pop()
            if mass:
                for x, begin, parts in arcs:
                    part = mass * exp(x - total)
                    share[begin] += part
                    for piece in parts:
                        counts[piece] = counts.get(piece, 0.0) + part

    for word in words:
        word = MARK + word
        keep = _shared(before, word)
        leave(keep)
        for end in range(keep + 1, len(word) + 1):
            arcs = _steps(pieces, word, end, forward)
            forward.append(_sum([x for x, _, _ in arcs]))
            steps.append(arcs)
            share.append(0.0)
        share[-1] += 1.0
        before = word
    leave(0)
    return counts


def _steps(pieces: Pieces, word: str, end: int, forward: list[float]) -> list[tuple[float, int, tuple[str, ...]]]:
    """Score, begin and pieces of each arc that ends at `end`."""
    score, tails, out, tail, k = pieces.score, pieces.tails, [], "", end
    while k:
        k -= 1
        tail = word[k] + tail
        own = score.get(tail)
        if own is not None:
            out.append((forward[k] + own, k, (tail,)))
            continue
        if k == end - 1:
            parts = tuple(pieces.spelled(tail))
            out.append((forward[k] + sum(score.get(p, pieces.unknown) for p in parts), k, parts))
        if tail not in tails:
            break
    return out


def _sum(scores: list[float]) -> float:
    if len(scores) == 1:
        return scores[0]
    top = max(scores)
    return top + log(sum([exp(x - top) for x in scores]))
