"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass of dynamic programming.

At each position the automaton's output links give, longest first, the pieces that end there. For a unigram model the best score of the
position is relaxed over them (Viterbi). For a byte-pair model the sum of scores is not what its library maximises (scores are merge
ranks, and their best sum is another segmentation), so the relaxation is over validity: of the pieces that end at a position exactly one
is the last of the library's encoding of that prefix, the one that is compatible with the last piece of the prefix before it, that is,
merging the two pieces' text gives the two pieces again. This is exact, and still one pass. Whether two pieces are compatible follows from
the merges that made them, undone from the last one on: none of the pieces' parts that stand side by side in between may merge earlier.

No piece of the supported models has a blank after another character, so the text falls apart before each run of blanks, and words are
encoded once per worker and remembered, in bounded caches that forget what was not used for longest.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readgrain.llm.common import documents, map_texts, own

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Words, and pairs of pieces, that a worker remembers: about 50 MB in all.
MOST = 150_000
#: Longer words are encoded each time.
LONGEST = 64
#: Characters that words have in common with others.
HEAD = 6
#: Runs of letters, and of other characters, to which Latin-1's raised digits and fractions belong.
RUN = re.compile(r"[^\W\d_²³¹¼½¾]+|[\W\d_²³¹¼½¾]+")


def read_model(path: str) -> dict:
    """What encoding needs of a model file: pieces, scores, kinds (1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte), type and normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    norm = m.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces:
        raise ValueError("only models with the identity normaliser are supported")
    if any(p.type == 4 for p in m.pieces):
        raise ValueError("models with user-defined pieces are not supported")
    if any(SPACE in p.piece.lstrip(SPACE) for p in m.pieces):
        raise ValueError("pieces that go beyond a word are not supported")
    return {"key": hashlib.md5(m.SerializeToString()).hexdigest(), "pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "kinds": [p.type for p in m.pieces], "type": m.trainer_spec.model_type, "prefix": norm.add_dummy_prefix, "unk": m.trainer_spec.unk_id, "unk_surface": m.trainer_spec.unk_surface}


class Recent(dict):
    """A dict that fills itself by fn. At half of `most` entries it starts anew, but what is asked for again comes over from the half before, so frequent entries stay; the answers don't depend on it."""

    def __init__(self, fn: Callable, most: int) -> None:
        super().__init__()
        self.fn, self.half, self.before = fn, max(1, most // 2), {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.before.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Words(Recent):
    """Recent, without the longest words."""

    def __missing__(self, key: str) -> tuple[int, ...]:
        if len(key) > LONGEST:
            return self.fn(key)
        value = self.before.get(key) or self.fn(key)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Node(dict):
    """A state of an Aho-Corasick automaton: the next states by character, the state of the longest other suffix, the pieces of several characters that end here, longest first, as (id, length), and the piece of one.

    States that follow by way of suffixes are noted down once they are asked for, while there is room.
    """

    __slots__ = ("ends", "one", "room", "suffix")

    def __missing__(self, c: str) -> Node:
        found = self if self.suffix is None else self.suffix[c]
        if self.suffix is not None and found.suffix is not None and self.room[0] > 0:
            self.room[0] -= 1
            self[c] = found
        return found

    def every(self) -> tuple:
        return self.ends if self.one is None else (*self.ends, (self.one, 1))


def automaton(ids: dict[str, int], most: int) -> Node:
    """The first state of the automaton of all pieces; at most `most` states by way of suffixes are noted down."""

    def new() -> Node:
        node = Node()
        node.ends, node.one, node.suffix, node.room = (), None, None, room
        return node

    room = [0]
    root = new()
    for p, i in ids.items():
        node = root
        for c in p:
            if c not in node:
                dict.__setitem__(node, c, new())
            node = node[c]
        if len(p) > 1:
            node.ends = ((i, len(p)),)
    level = [root]
    while level:  # by depth, so suffixes are ready
        below = []
        for node in level:
            for c, child in node.items():
                child.suffix = root if node is root else node.suffix[c]
                child.ends += child.suffix.ends
                child.one = ids.get(c)
                below.append(child)
        level = below
    room[0] = most
    return root


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict, most: int = MOST) -> None:
        self.pieces, self.scores, self.type, self.prefix = model["pieces"], model["scores"], model["type"], model["prefix"]
        kinds = model["kinds"]
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == 1}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == 6}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.unk, self.surface = model["unk"], model["unk_surface"]
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.low = min(self.scores) - 10.0
        self.root = automaton(self.ids, most)
        #: No piece holds a line feed, so no piece goes beyond a line, and lines can be cut before words are.
        self.lines = not any("\n" in p for p in self.ids)
        #: The text of each id; null where what stands beside it matters (bytes of longer characters).
        self.plain = [("" if k == 3 else self.surface if i == self.unk else chr(int(p[3:5], 16)) if k == 6 and int(p[3:5], 16) < 128 else None if k == 6 else p.replace(SPACE, " ")) for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True))]
        self.sizes = [len(p) for p in self.pieces]
        #: The order in which pieces are merged, the best score first; -1: a character. Pieces of several blanks share one score, and words with them don't ask for it.
        order = sorted((i for p, i in self.ids.items() if len(p) > 1 and SPACE * 2 not in p), key=lambda i: -self.scores[i])
        self.rank = [-1] * len(self.pieces)
        for n, i in enumerate(order):
            self.rank[i] = n
        self.ordered = len({self.scores[i] for i in order}) == len(order)
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Whether two pieces fit, by the first one's id times the number of pieces and the second one's.
        self.fits = Recent(lambda pair: self._fits(divmod(pair, len(self.pieces))), 2 * most)
        #: State and last pieces after the first characters of words, from which the pass goes on.
        self.heads = Recent(self._head, most // 4)
        #: No piece holds a letter beside another character, so words fall apart between them.
        self.runs = all(len(RUN.findall(p.lstrip(SPACE))) <= 1 for p in self.ids)
        #: Words as they stand, and those behind one blank, by what follows it.
        self.words = Words(lambda word: self._runs(word, ""), most // 2)
        self.after = Words(lambda word: self._runs(word, SPACE), most)
        self.newline = self._word("\n") if self.lines else ()

    def spell(self, c: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.byte[b] for b in c.encode("utf-8")] if self.byte else [self.unk]

    def merge(self, text: str, made: list | None = None) -> list[str]:
        """Byte-pair merging by its definition: of all neighbours whose join is a piece, the best score first, then the leftmost. made: gets the pairs that were merged."""
        n, ids, scores = len(text), self.ids, self.scores
        part, left, right = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (k := ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-scores[k], i, j, len(part[i]), len(part[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if len(part[i]) != a or len(part[j]) != b or right[i] != j:
                continue
            if made is not None:
                made.append((part[i], part[j]))
            part[i] += part[j]
            part[j] = ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p]

    def _halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes a piece; null if merging its text doesn't make it, or if one of the merges before it has a worse score than one that it leads to."""
        if i not in self.halves:
            self.halves[i] = None
            made: list = []
            if self.merge(self.pieces[i], made) == [self.pieces[i]]:
                a, b = (self.ids.get(p) for p in made[-1])
                if all(k is not None and self.rank[k] < self.rank[i] and (self.sizes[k] == 1 or self._halves(k)) for k in (a, b)):
                    self.halves[i] = a, b
        return self.halves[i]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Merging the pieces' text gives the two pieces again.

        The merges of both are undone from the last one on. The parts that stand at the border before a merge don't merge with each other if
        their join is no piece, or comes later than that merge; of equal ones the left one comes first.
        """
        (x, y), rank, ids, pieces, halves, sizes = pair, self.rank, self.ids, self.pieces, self.halves, self.sizes
        if not self.ordered or sizes[x] > 1 and not (halves.get(x) or self._halves(x)) or sizes[y] > 1 and not (halves.get(y) or self._halves(y)):
            return self.merge(pieces[x] + pieces[y]) == [pieces[x], pieces[y]]
        limit = len(rank)
        while True:
            both = ids.get(pieces[x] + pieces[y])
            if both is not None and rank[both] < limit:
                return False
            if rank[x] > rank[y]:
                limit, x = rank[x], halves[x][1]
            elif rank[y] >= 0:
                limit, y = rank[y] + 1, halves[y][0]
            else:
                return True

    def _runs(self, word: str, blank: str) -> tuple[int, ...]:
        """Ids of a blank, if any, and a word; words that fall apart are put together from their parts."""
        if self.runs and SPACE not in word and not word.isalpha() and len(parts := RUN.findall(word)) > 1:
            words = self.words
            return tuple(chain((self.after if blank else words)[parts[0]], *[words[p] for p in parts[1:]]))
        return self._word(blank + word)

    def _word(self, text: str) -> tuple[int, ...]:
        """Ids of a run of blanks, if any, and the word after it, by one pass of the automaton."""
        if SPACE * 2 in text and self.type == BPE:  # pieces of several blanks share one score: merging by definition
            return tuple(i for p in self.merge(text) for i in ([self.ids[p]] if p in self.ids else self.spell(p)))
        n, ids = len(text), self.ids
        if self.type == BPE:
            if n > HEAD:
                node, known = self.heads[text[:HEAD]]
                last = list(known)
                self._pass(text[HEAD:], node, last)
            else:
                last = [None]
                self._pass(text, self.root, last)
            if last.count(None) == 1:  # all characters are covered
                out, sizes = [], self.sizes
                while n:
                    out.append(i := last[n])
                    n -= sizes[i]
                return tuple(out[::-1])
        last: list[int | None] = [None] * (n + 1)  # the last piece of each prefix; -1: a character that no piece covers
        size, node = [0] * (n + 1), self.root
        best = [0.0] + [float("-inf")] * n
        for j, c in enumerate(text, 1):
            node = node[c]
            if self.type == BPE:
                for i, k in node.every():
                    before = last[j - k]
                    if j == k or before is not None and (before == -1 or self.fits[before * len(self.pieces) + i]):
                        last[j], size[j] = i, k
                        break
                else:
                    if c not in ids:
                        last[j], size[j] = -1, 1
            else:
                for i, k in node.every():
                    if best[j - k] + self.scores[i] > best[j]:
                        best[j], last[j], size[j] = best[j - k] + self.scores[i], i, k
                if c not in ids and best[j - 1] + self.low > best[j]:
                    best[j], last[j], size[j] = best[j - 1] + self.low, -1, 1
        return self._back(text, last, size)

    def _pass(self, text: str, node: Node, last: list[int | None]) -> Node:
        """Goes on with text in a state; last has the last piece of each prefix so far, and gets those that text adds: null where a character is not covered."""
        fits, many, j = self.fits, len(self.pieces), len(last)
        for c in text:
            node = node[c]
            for i, k in node.ends:  # the longest first
                if j == k or (before := last[j - k]) is not None and fits[before * many + i]:
                    last.append(i)
                    break
            else:  # of the pieces that end here one is the last, so what is left needs no look
                last.append(node.one)
            j += 1
        return node

    def _head(self, text: str) -> tuple[Node, tuple]:
        last: list[int | None] = [None]
        return self._pass(text, self.root, last), tuple(last)

    def _back(self, text: str, last: list, size: list[int]) -> tuple[int, ...]:
        n = len(text)
        if last[n] is None:  # not reached; the definition needs no argument
            return tuple(i for p in self.merge(text) for i in ([self.ids[p]] if p in self.ids else self.spell(p)))
        out: list[int] = []
        while n:
            out += self.spell(text[n - 1])[::-1] if last[n] == -1 else [last[n]]
            n -= size[n]
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if SPACE in text:  # read as a blank
            text = text.replace(SPACE, " ")
        if self.prefix:
            text = " " + text
        words, after = self.words, self.after
        out: list[int] = []
        for n, line in enumerate(text.split("\n") if self.lines else [text]):
            if n:
                out += self.newline
            parts = line.split(" ")
            head = parts.pop(0)
            if head:
                out += words[head]
            if "  " not in line and line[-1:] != " ":
                out += chain.from_iterable(map(after.__getitem__, parts))
                continue
            blanks = 0
            for p in parts:
                blanks += 1
                if p:
                    out += after[p] if blanks == 1 else words[SPACE * blanks + p]
                    blanks = 0
            if blanks:
                out += words[SPACE * blanks]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a blank that encoding put before it is taken off. Byte pieces that are no UTF-8 become U+FFFD each."""
        try:
            text = "".join(map(self.plain.__getitem__, ids))
            return text[1:] if self.prefix and text.startswith(" ") else text
        except TypeError:  # bytes of longer characters
            pass
        out, raw = [], bytearray()

        def flush() -> None:
            if raw:
                out.append(as_text(bytes(raw)))
                raw.clear()

        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            flush()
            out.append(self.surface if i == self.unk else "" if i in self.control else self.pieces[i])
        flush()
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def as_text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


def codec_of(model: dict, most: int = MOST) -> Codec:
    """The codec of a model in this worker process: its automaton is built, and its words are remembered, once and not once a task."""
    return own(("pieces", model["key"], most), lambda: Codec(model, most))


def encode(docs: DataFrame, model_path: str, columns: list[str], most: int = MOST) -> DataFrame:
    """`columns` of docs, then ids (array), n_tokens and round_trip (decoding gives the text again), a row per row.

    A null or empty text has no ids. Texts are encoded whole, whatever their length. round_trip is false for texts that hold U+2581, which
    the model reads as a blank. Repeated rows get equal results; an empty table gives an empty one. `columns` must not be ids, n_tokens or
    round_trip; other columns of docs aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def make() -> Callable[[str], tuple]:
        codec = codec_of(sent.value, most)

        def each(text: str) -> tuple:
            ids = codec.encode(text)
            return ids, len(ids), codec.decode(ids) == text

        return each

    return map_texts(docs, make, "ids array<int>, n_tokens long, round_trip boolean", columns, keep=True)


def decode(rows: DataFrame, model_path: str, columns: list[str]) -> DataFrame:
    """`columns` of rows, then the text of its ids, a row per row; null ids give a null text, no ids an empty one. An empty table gives an empty one."""
    sent = rows.sparkSession.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        codec = codec_of(sent.value)
        return ids.map(lambda x: None if x is None else codec.decode(list(x)))

    return rows.select(*columns, text_of("ids").alias("text"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its ids, their number, and whether decoding gives the text again."""
    return encode(documents(spark, sf_dir), model_path(), ["doc_id"])
