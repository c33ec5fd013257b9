"""SentencePiece BPE by vectorised merge rounds, and decoding.

A text is cut into units that no piece of the vocabulary can span, so units are encoded on their own
and exactly. The distinct new units of a slice of documents lie in one flat array of symbols. Every
round finds the best pair of each unit, merges its occurrences from the left in all units at once (as
far as that is what one merge at a time would do), and compacts the array, until no pair is left.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from aerolith.llm.common import ends_of, map_texts

SPACE = "▁"
#: Units a process remembers, and as many older ones. It forgets the oldest; results do not change.
REMEMBERED = 60_000
#: New units encoded together.
_UNITS = 1 << 14

_NONE = np.iinfo(np.int64).max


class PieceModel:
    """Tables of a SentencePiece BPE vocabulary, and encoding and decoding with them."""

    def __init__(self, model_file: str):
        reader = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = reader.get_piece_size()
        self.pieces = [reader.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i))]
        scores = {i: reader.get_score(i) for i in plain}
        self.unknown = reader.unk_id()
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(size) if reader.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i in range(size) if reader.is_control(i)}
        self.special = {*self.byte_of, *self.control, self.unknown}
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        self.ids = {self.pieces[i]: i for i in plain}
        self._tables(plain, scores)
        self._units(plain, scores)

    def _tables(self, plain: list[int], scores: dict[int, float]) -> None:
        """Sorted pair keys with what they merge to; rank of a merge (best score first, equal scores share one)."""
        size = len(self.pieces)
        best = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rows = sorted((self.ids[p[:k]] * size + self.ids[p[k:]], i) for i in plain for p in [self.pieces[i]] for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.pair_keys = np.array([k for k, _ in rows], dtype=np.int64)
        self.pair_piece = np.array([i for _, i in rows], dtype=np.int64)
        self.rank = np.full(size + 1, _NONE, dtype=np.int64)  # the last place is for no piece
        self.rank[plain] = [best[scores[i]] for i in plain]

    def _units(self, plain: list[int], scores: dict[int, float]) -> None:
        """The pattern of units: runs of spaces with what follows, and characters no longer piece contains."""
        inner = {c for i in plain if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        separate = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain)
        chars = "".join(re.escape(c) for c in sorted(inner - {SPACE}))
        one = f"[{chars}]" if chars else "(?!)"
        runs = {len(self.pieces[i]): i for i in plain if not self.pieces[i].strip(SPACE)}
        longest, head = max(runs, default=0), ""
        if longest > 1:
            # If spaces are joined last and from the left, all but the end of a long run falls into longest pieces.
            last = max(self.rank[plain])
            full = runs[longest]
            alone = not (self.pair_keys // len(self.pieces) == full).any()
            if alone and all(self.rank[i] == last for n, i in runs.items() if n > 1) and self.encode_units([SPACE * (3 * longest + 1)])[0][:2] == [full, full]:
                head = f"{SPACE}{{{longest}}}(?={SPACE}{{{longest + 1}}})|"
        self.pattern = re.compile(f"{head}{SPACE}+{one}*|{one}+|[^{chars}{SPACE}]" if separate else r"(?s).+")

    def units(self, text: str) -> list[str]:
        """The text as the model sees it (spaces marked, one in front), cut into units. Empty for an empty text."""
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        keys = np.where((left < 0) | (right < 0), -1, left * len(self.pieces) + right)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_piece[at], -1)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit. All units advance in every round.

        A round merges the occurrences of a unit's best pair from the left. It stops behind the first
        whose merge makes a pair that is as good or better, as that one is next in order.
        """
        first, ends = ends_of(units)
        text = "".join(units)
        lookup = {c: self.ids.get(c, -1) for c in set(text)}
        symbols = np.fromiter(map(lookup.__getitem__, text), dtype=np.int64, count=len(text))
        unit = np.repeat(np.arange(len(units)), ends - first)
        where = np.arange(len(text))
        pair = np.append(self._merges(symbols[:-1], symbols[1:]), -1) if len(text) else symbols
        pair[:-1][unit[:-1] != unit[1:]] = -1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = self.rank[pair]
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            # A unit without a pair leaves the array; most words are done after a few rounds.
            out = np.repeat(least == _NONE, sizes)
            if out.any():
                done.append((where[out], symbols[out]))
            hit = np.flatnonzero((rank == np.repeat(least, sizes)) & ~out)
            if len(hit):
                opening = np.append(True, unit[hit][1:] != unit[hit][:-1])
                # Neighbouring occurrences overlap: in a run of them every second one is merged.
                run = np.append(True, hit[1:] != hit[:-1] + 1) | opening
                hit = hit[(hit - np.maximum.accumulate(np.where(run, hit, 0))) % 2 == 0]
                new, level = pair[hit], rank[hit]
                before = np.where((hit > 0) & (unit[hit - 1] == unit[hit]), symbols[hit - 1], -1)
                joined = np.append(False, (hit[1:] == hit[:-1] + 2) & (unit[hit[1:]] == unit[hit[:-1]]))
                before[joined] = new[np.flatnonzero(joined) - 1]
                next_at = np.minimum(hit + 2, len(symbols) - 1)
                after = np.where((hit + 2 < len(symbols)) & (unit[next_at] == unit[hit]), symbols[next_at], -1)
                early = (self.rank[self._merges(before, new)] <= level) | (self.rank[self._merges(new, after)] <= level)
                # only occurrences with no early one before them in their unit
                opening = np.flatnonzero(np.append(True, unit[hit][1:] != unit[hit][:-1]))
                earlier = np.cumsum(early) - early
                hit = hit[earlier == np.repeat(earlier[opening], np.diff(np.append(opening, len(hit))))]
                symbols[hit] = pair[hit]
                out[hit + 1] = True
            kept = np.cumsum(~out) - 1
            symbols, unit, where, pair = symbols[~out], unit[~out], where[~out], pair[~out]
            if len(hit):
                changed = np.zeros(len(symbols) + 1, dtype=bool)
                changed[kept[hit]] = changed[kept[hit] - 1] = True
                at = np.flatnonzero(changed[:-1])
                right = np.minimum(at + 1, len(symbols) - 1)
                inside = (at + 1 < len(symbols)) & (unit[right] == unit[at])
                pair[at] = np.where(inside, self._merges(symbols[at], symbols[right]), -1)
        return self._listed(text, first, done)

    def _listed(self, text: str, first: np.ndarray, done: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
        if not done:
            return [[] for _ in first]
        where, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(where)
        where, symbols = where[order], symbols[order]
        cuts = [*np.searchsorted(where, first).tolist(), len(where)]
        flat = symbols.tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in sorted({int(np.searchsorted(first, w, side="right")) - 1 for w in where[symbols < 0]}):
            a, b = cuts[i], cuts[i + 1]
            out[i] = [x for w, s in zip(where[a:b].tolist(), flat[a:b], strict=True) for x in ([s] if s >= 0 else self._fallback(text[w]))]
        return out

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8")] if self.byte_ids else [self.unknown]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_units(self.units(text)) for i in ids]

    def decode(self, ids: list[int], opening: bool = True) -> str:
        """The text of the ids. ``opening``: they begin a text, whose space in front is taken off."""
        if not self.special.intersection(ids):
            text = "".join([self.surface[i] for i in ids])
            return text.removeprefix(" ") if opening else text
        parts: list[str] = []
        pending = bytearray()

        def settle() -> None:
            data, k = bytes(pending), 0
            while k < len(data):
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(data[k : k + n].decode("utf-8"))
                        k += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    k += 1
            pending.clear()

        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                opening = False
                continue
            settle()
            if i in self.control:
                continue
            piece = " ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " ")
            if opening and i != self.unknown:
                piece = piece.removeprefix(" ")
            parts.append(piece)
            opening = False
        settle()
        return "".join(parts)


@lru_cache(maxsize=2)
def load(model_file: str) -> PieceModel:
    """The model's tables, read once per process from a file that every executor has."""
    return PieceModel(model_file)


class Units(dict):
    """Unit -> [ids joined by commas, decoded text], of the units met lately, with those still to be filled in."""

    def __init__(self):
        self.older: dict[str, list] = {}
        self.new: list[str] = []

    def __missing__(self, unit: str) -> list:
        entry = self.older.get(unit)
        if entry is None:
            entry = [None, None]
            self.new.append(unit)
        self[unit] = entry
        return entry

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


class Codec:
    """Encodes and decodes many texts, remembering the units it has met lately."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known = Units()

    def run(self, texts: list[str]) -> list[tuple[str, str]]:
        """The ids of each text, joined by commas, and what they decode to."""
        known = self.known
        known.age()
        entries = [list(map(known.__getitem__, self.model.units(t))) for t in texts]
        for start in range(0, len(known.new), _UNITS):
            group = known.new[start : start + _UNITS]
            for unit, ids in zip(group, self.model.encode_units(group), strict=True):
                known[unit][:] = ",".join(map(str, ids)), self.model.decode(ids, opening=False)
        known.new.clear()
        return [(",".join([e[0] for e in row]), "".join([e[1] for e in row]).removeprefix(" ")) for row in entries]


@lru_cache(maxsize=2)
def shared_codec(model_file: str) -> Codec:
    return Codec(load(model_file))


def encode_decode(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), full: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each text, after the columns ``keep``.

    With ``full`` also the ids (array of int) and the decoded text. A null or empty text has no ids and
    decodes to the empty text. Characters outside the vocabulary become byte pieces. Texts of any length
    are encoded whole. Repeated rows are kept.
    """
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")

    def work():
        codec = shared_codec(model_file)

        def run(texts: list[bytes]) -> dict[str, list]:
            done = codec.run([t.decode("utf-8") for t in texts])
            made = {
                "n_tokens": [ids.count(",") + 1 if ids else 0 for ids, _ in done],
                "ids_sha256": [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in done],
                "decoded_sha256": [hashlib.sha256(text.encode("utf-8")).hexdigest() for _, text in done],
            }
            if full:
                made["ids"] = [np.array([int(x) for x in ids.split(",")] if ids else [], dtype=np.int32) for ids, _ in done]
                made["decoded"] = [text for _, text in done]
            return made

        return run

    return map_texts(docs, out, work, keep=keep)
