"""Merge-type (BPE) SentencePiece encoding by backtracking, and decoding.

The encoder never runs the merge loop over a whole text.  It takes, at each
position, the longest piece that an Aho-Corasick automaton finds there, keeps
it if it is compatible with the piece before it (re-merging the two gives the
same two pieces again), and otherwise tries the next shorter piece; a position
from which nothing fits is marked in a bitfield of failed positions and the
previous piece is shortened.  A sequence of pieces whose neighbours are all
compatible is the result of the merge loop, so the ids equal the library's.

Pieces that the merge loop never yields for their own text are left out of the
automaton.  Runs of the space mark, whose pieces all have one score, are merged
by the loop itself.  A character that no piece holds becomes its bytes.
"""

from __future__ import annotations

import re
from itertools import chain

MARK = "▁"
#: Entries that each cache of a Python worker may hold before its older half goes.
CACHE_ENTRIES = 350_000


class PieceBPE:
    """Encoder and decoder for one SentencePiece model of the BPE kind."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.raw: list[bytes] = []
        self.is_byte: list[bool] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            byte = sp.is_byte(i)
            self.is_byte.append(byte)
            if byte:
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.id[piece] = i
                self.score[piece] = sp.get_score(i)
                self.raw.append(piece.replace(MARK, " ").encode())
        self.unk = sp.unk_id()
        self.known = set().union(*self.id) if self.id else set()
        self.piece = {i: p for p, i in self.id.items()}
        self.decimal = [str(i) for i in range(sp.vocab_size())]
        self.whole: set[str] = set()
        self._pairs: dict[int, bool] = {}
        self._chunks: dict[str, tuple[tuple[int, ...], str]] = {}
        self._older: dict[str, tuple[tuple[int, ...], str]] = {}
        self._runs: dict[int, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if MARK not in piece[1:] and (len(piece) == 1 or self.merged(piece) == [piece]):
                self.automaton.add_word(piece, (len(piece), self.id[piece]))
                self.whole.add(piece)
        self.automaton.make_automaton()
        # No piece joins a character to a following mark, so a text falls apart
        # before every run of marks; likewise at line ends if no piece has one.
        self._split = re.compile(f"{MARK}+[^{MARK}]*" if "\n" in self.known
                                 else f"{MARK}+[^{MARK}\n]*|\n+[^{MARK}\n]*").findall

    def merged(self, text: str) -> list[str]:
        """The merge loop itself: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether re-merging the two pieces' characters gives the two again."""
        a, b = self.piece[left], self.piece[right]
        return self.merged(a + b) == [a, b]

    def _segment(self, text: str) -> list[int]:
        """Backtracking over one stretch of known characters (at most one
        leading mark)."""
        if text in self.whole:
            return [self.id[text]]
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):     # by end: shorter pieces first
            starts[end - found[0] + 1].append(found)
        pairs = self._pairs
        pos, last = 0, -1
        alive = bytearray(b"\x01") * (n + 1)            # 0: nothing fits from here
        out: list[int] = []
        tried: list[int] = []                            # index in starts[] of each piece taken
        i = len(starts[0]) - 1
        while pos < n:
            options = starts[pos]
            while i >= 0:
                size, piece = options[i]
                if alive[pos + size]:
                    if last < 0:
                        break
                    key = last << 32 | piece
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= CACHE_ENTRIES:
                            pairs.clear()
                        fits = pairs[key] = self.compatible(last, piece)
                    if fits:
                        break
                i -= 1
            if i >= 0:
                out.append(piece)
                tried.append(i)
                last = piece
                pos += size
                i = len(starts[pos]) - 1 if pos < n else -1
                continue
            alive[pos] = 0
            if not out:
                raise ValueError("no sequence of pieces fits")
            pos -= len(self.piece[out.pop()])
            last = out[-1] if out else -1
            i = tried.pop() - 1
        return out

    def _mark_run(self, n: int) -> list[int]:
        """Ids of n marks in a row."""
        got = self._runs.get(n)
        if got is None:
            got = [self.id[p] for p in self._merged_marks(n)]
            if len(self._runs) < 4096:
                self._runs[n] = got
        return got

    def _merged_marks(self, n: int) -> list[str]:
        """The merge loop over marks.  All mark pieces share one score, so the
        leftmost pair that makes a piece goes first; lengths are enough."""
        sizes = {len(p) for p in self.id if set(p) == {MARK}}
        done: list[int] = []
        rest = n
        # Left of the current pair nothing merges: grow it one mark at a time.
        while rest:
            done.append(1)
            rest -= 1
            while True:
                if len(done) > 1 and done[-2] + done[-1] in sizes:
                    done[-2:] = [done[-2] + done[-1]]
                elif rest and done[-1] + 1 in sizes:
                    done[-1] += 1
                    rest -= 1
                else:
                    break
        return [MARK * k for k in done]

    def _ids(self, chunk: str) -> list[int]:
        body = chunk.lstrip(MARK)
        marks = len(chunk) - len(body)
        if marks:
            body = MARK + body
            marks -= 1
        ids: list[int] = []
        for part in (body,) if self.known.issuperset(body) else self._known_parts(body):
            if part[:1] in self.known:
                ids += self._segment(part)
            else:
                ids += [self.byte.get(b, self.unk) for b in part.encode()]
        if marks or (ids and ids[0] == self.id.get(MARK)):
            absorbed = not (ids and ids[0] == self.id.get(MARK))
            ids = self._mark_run(marks + (not absorbed)) + ids[0 if absorbed else 1:]
        return ids

    def _known_parts(self, text: str):
        """Stretches of known characters, and each unknown character alone."""
        known, begin = self.known, 0
        for i, c in enumerate(text):
            if c not in known:
                if i > begin:
                    yield text[begin:i]
                yield c
                begin = i + 1
        if begin < len(text):
            yield text[begin:]

    def _cached(self, chunk: str) -> tuple[tuple[int, ...], str]:
        got = self._older.get(chunk)
        if got is None:
            ids = tuple(self._ids(chunk))
            decimal = self.decimal
            got = (ids, ",".join([decimal[i] for i in ids]))
        if len(chunk) <= 64:
            if len(self._chunks) >= CACHE_ENTRIES:       # the older half goes
                self._older, self._chunks = self._chunks, {}
            self._chunks[chunk] = got
        return got

    def _parts(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        if not text:
            return []
        cached = self._cached
        return [self._chunks.get(c) or cached(c)
                for c in self._split(MARK + text.replace(" ", MARK))]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(p[0] for p in self._parts(text)))

    def encode_joined(self, text: str) -> tuple[list[int], str]:
        """The ids, and their decimal forms joined by commas."""
        parts = self._parts(text)
        return list(chain.from_iterable(p[0] for p in parts)), ",".join([p[1] for p in parts])

    def length(self, text: str) -> int:
        return sum([len(p[0]) for p in self._parts(text)])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, the first space goes, bytes join
        to characters, and a byte that belongs to none becomes U+FFFD."""
        raw = self.raw
        try:
            text = b"".join([raw[i] for i in ids]).decode()
        except UnicodeDecodeError:
            text = self._decode_slowly(ids)
        first = next((i for i in ids if raw[i]), None)
        return text[1:] if first is not None and text[:1] == " " and not self.is_byte[first] \
            and first != self.unk else text

    def _decode_slowly(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.raw[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    del run[:1]
            if i is not None:
                out.append(self.raw[i].decode())
        return "".join(out)


_loaded: dict[str, PieceBPE] = {}


def load(model_file: str) -> PieceBPE:
    """The encoder of a model file, built once per Python worker."""
    if model_file not in _loaded:
        _loaded[model_file] = PieceBPE(model_file)
    return _loaded[model_file]
