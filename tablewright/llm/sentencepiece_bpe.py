"""SentencePiece BPE, encoded with a table of last tokens by prefix and decoded again.

The merges of such a model decide one token for the end of every prefix of a string: the longest-standing
tiling is unique, and a token may follow another only if merging never joins across their border. So the table
is filled from left to right: an automaton lists the pieces that end at a place, and the one is stored whose
border with the stored token before it holds. The ids are then read backwards from the end.

A border between two tokens is tested by undoing merges: the pair is wrong if some part of the left token and
some part of the right token would have merged before the merges that made the tokens.

The model's runs of spaces merge after everything else and at equal scores, so a text is cut before every
space that a non-space follows, the parts are encoded on their own (and remembered by the task), and runs of
spaces that are left bare are merged from the left by the model's scores.

Null texts are empty ones: they hold the end id only and decode to nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from tablewright.llm.shared import Memory, id_and_text, map_texts

SPACE = "▁"
_runs = re.compile(r"\w+|\W+")
#: words and stems that a task remembers, and borders
CACHE, BORDERS = 200_000, 500_000
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        skip = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in skip}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.single = {p for p in self.ids if len(p) == 1}
        # order of merges: higher scores first
        self.rank = {p: -s for p, s in self.score.items()}
        self.names = [str(i) for i in range(n)]
        # what each id decodes to: control ids to nothing, byte ids to their byte
        self.sounds = [b"" if model.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for byte, i in self.byte_ids.items():
            self.sounds[i] = bytes([byte])
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and not p.strip(SPACE) == "" and SPACE not in p[1:] and self.split(p) is not None:
                self.automaton.add_word(p, (self.ids[p], len(p)))
        self.automaton.make_automaton()
        self.borders: dict[int, bool] = {}
        #: neighbours inside some piece; between any other two characters nothing ever merges
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.stems, self.known = Memory(CACHE), Memory(CACHE)

    # -- the last merge that makes a piece, found by merging its characters once

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two tokens of the piece's last merge; None if merging its characters never gives it."""
        if piece not in self.halves:
            parts = list(piece)
            last = None
            while len(parts) > 1:
                best = min(((self.rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
                if best[0] == float("inf"):
                    break
                i = best[1]
                last = (parts[i], parts[i + 1])
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging keeps these tokens apart when they stand side by side.

        Going back through the merges of both, latest first, every pair of neighbouring parts across the border
        must not be a piece that would have merged before the later of the merges undone so far.
        """
        rank, limit = self.rank, float("inf")
        left_first = False  # on equal ranks the left place merges first
        while True:
            joined = rank.get(left + right)
            if joined is not None and (joined < limit or joined == limit and left_first):
                return False
            made_left = rank[left] if len(left) > 1 else -float("inf")
            made_right = rank[right] if len(right) > 1 else -float("inf")
            if made_left == made_right == -float("inf"):
                return True
            # undo the later merge; of equal ones the right one is later, for the left place goes first
            if made_right >= made_left:
                limit, left_first = made_right, True
                right = self.split(right)[0]
            else:
                limit, left_first = made_left, False
                left = self.split(left)[1]

    def holds(self, left: int, right: int) -> bool:
        key = left << 17 | right
        found = self.borders.get(key)
        if found is None:
            if len(self.borders) >= BORDERS:
                self.borders.clear()
            text = self.pieces[left] if left < len(self.pieces) else ""
            found = self.borders[key] = not text or self.compatible(text, self.pieces[right])
        return found

    def tokens(self, part: str) -> list[int]:
        """Tokens of a string without bare runs of spaces; a character outside the model is the number of pieces."""
        get, outside = self.ids.get, len(self.pieces)
        last = [get(c, outside) for c in part]  # by prefix; a single character unless a longer piece fits
        length = [1] * len(part)
        borders, holds = self.borders, self.holds
        for at, (piece, n) in self.automaton.iter(part):
            # several pieces may end here; at most one of them can follow the token before it
            if length[at] == 1:
                start = at - n
                if start < 0:
                    last[at], length[at] = piece, n
                else:
                    fits = borders.get(last[start] << 17 | piece)
                    if fits is None:
                        fits = holds(last[start], piece)
                    if fits:
                        last[at], length[at] = piece, n
        out = []
        at = len(part) - 1
        while at >= 0:
            out.append((last[at], at))
            at -= length[at]
        return out[::-1]

    # -- runs of spaces

    @lru_cache(1024)
    def run(self, n: int) -> tuple[int, ...]:
        """Ids of n bare spaces: the best-scored pair merges first, of equal ones the leftmost."""
        parts: list = [SPACE] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i):
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and parts[i] + parts[j] in self.rank:
                heapq.heappush(heap, (self.rank[parts[i] + parts[j]], i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return tuple(self.ids[p] for p in parts if p)

    # -- texts

    def part(self, word: str, spaced: bool) -> tuple[list[int], bool]:
        """Ids of a word, with a space before it where ``spaced``, and whether that space stayed bare.

        The word is cut first between letters and other characters wherever no piece holds both neighbours.
        """
        stems: list[str] = []
        last = SPACE if spaced else ""
        for run in _runs.findall(word):
            if last and (last[-1] + run[0] in self.inside or last == SPACE):
                last += run
            else:
                if last:
                    stems.append(last)
                last = run
        stems.append(last)
        ids: list[int] = []
        for stem in stems:
            if stem not in self.stems.young:
                for fresh in self.stems.missing([stem]):
                    self.stems.young[fresh] = self.stem(fresh)
            ids += self.stems.young[stem]
        return ids, spaced and ids[0] == self.ids[SPACE]

    def stem(self, text: str) -> list[int]:
        ids: list[int] = []
        for token, at in self.tokens(text):
            if token < len(self.pieces):
                ids.append(token)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in text[at].encode("utf-8", "replace")]
            else:
                ids.append(self.unknown)
        return ids

    def look(self, words: list[str]) -> list[tuple]:
        """For words after a space: is the space bare, count of ids, ids as text, decoded bytes."""
        for w in self.known.missing(words):
            ids, bare = self.part(w, True)
            self.known.young[w] = (bare, len(ids), " ".join(map(self.names.__getitem__, ids)), self.decoded(ids))
        return list(map(self.known.young.__getitem__, words))

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join(map(self.sounds.__getitem__, ids))

    def words_of(self, text: str) -> list[str]:
        return text.replace(SPACE, " ").split(" ")

    def encode(self, text: str) -> list[int]:
        """All ids with the end id."""
        return [int(x) for x in self.digest_parts(text)[1].split()] if text else [self.end]

    def digest_parts(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, ids as text, decoded text without its first space."""
        if not text:
            return 1, str(self.end), b""
        words = self.words_of(text)
        if "" not in words:  # no run of spaces
            found = self.look(words)
            count = sum([f[1] for f in found]) + 1
            return count, " ".join([f[2] for f in found]) + f" {self.end}", b"".join([f[3] for f in found])[1:]
        count, ids, data, bare = 0, [], [], 0
        for w in words:
            if not w:
                bare += 1
                continue
            f = self.look([w])[0]
            if not bare:
                count, _ = count + f[1], ids.append(f[2])
                data.append(f[3])
                continue
            if f[0]:  # its own space joins the run
                head, (tail, _) = self.run(bare + 1), self.part(w, True)
                tail = tail[1:]
            else:
                head, (tail, _) = self.run(bare), self.part(w, True)
            both = list(head) + tail
            count += len(both)
            ids.append(" ".join(map(str, both)))
            data.append(self.decoded(both))
            bare = 0
        if bare:
            head = list(self.run(bare))
            count += len(head)
            ids.append(" ".join(map(str, head)))
            data.append(self.decoded(head))
        ids.append(str(self.end))
        return count + 1, " ".join(ids), b"".join(data)[1:]


@lru_cache(4)
def codec_of(path: str) -> Codec:
    """One for the process, so that the tasks of a worker share what it has learned."""
    return Codec(path)


def sentencepiece_digests(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """Number of ids, hash of the ids and hash of the decoded text of every row."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def make():
        codec = codec_of(path)

        def digests(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in texts:
                count, ids, data = codec.digest_parts(t or "")
                out["n_tokens"].append(count)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
            return out
        return digests

    return map_texts(id_and_text(docs, id_col, text_col), make, SCHEMA)
