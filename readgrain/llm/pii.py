"""Personal data by a semi-Markov conditional random field over whole-span features.

The base patterns give spans on their own. The field adds those the patterns miss (addresses written with "at" and "dot", telephone
numbers without a plus sign, card and network addresses with unusual separators). A text is cut exactly into regions: outside them no
span can score, as a span must hold what its kind needs. Within a region the tokens are cut into segments; a segment is one token of no
kind, or up to MOST_TOKENS tokens of a kind, scored on features of the whole segment (shape, digits, checksum, separators, the words
before it, what stands beside it). Dynamic programming over segment ends chooses boundaries and kinds at once; training maximises the
conditional likelihood by the same recursion, on sentences made here from templates.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readgrain.llm.common import documents, map_texts, slices, task

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS, MOST_CHARS = 24, 100

LOCAL = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-".decode())
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return (odd + even) % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits is 255 at most, however long."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of the pattern, found from each @ outward, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out = [(a, 0, b) for a, b in base_emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]|\s")
#: Where a span without a base pattern may stand: runs of digits and their separators, and words around "at" ... "dot".
NUMBERS = re.compile(r"[+(]?[0-9][0-9 ().\-\[\]/]{5,}[0-9]")
MARKED = re.compile(r"[A-Za-z0-9._%+-]{1,40} ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,40}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{1,40}){1,6}", re.I)
#: What any match of MARKED holds, unless a base span holds its @: a marker other than @, or blanks beside @ or the first dot. Of each only the first sign is taken, as they can overlap.
HINT = re.compile(r"\((?=at\)|dot\))|\[(?=at\]|dot\])|\{(?=at\}|dot\})|@(?= |[A-Za-z0-9-]{1,40}(?: \.|\. ))| (?=@|dot |at  ?[A-Za-z0-9-]{1,40} ?\.)", re.I)
TOP = re.compile(r"(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl)$", re.I)
CUES = {0: ("mail", "contact", "write"), 1: ("ip", "host", "server", "address"), 2: ("card", "visa", "credit", "payment"), 3: ("tel", "phone", "call", "mobile", "fax", "ring")}


def regions(text: str) -> list[tuple[int, int]]:
    found = [(m.start(), m.end()) for m in NUMBERS.finditer(text)]
    for m in HINT.finditer(text):
        low = max(0, m.start() - MOST_CHARS)
        found += [(low + x.start(), low + x.end()) for x in MARKED.finditer(text[low : m.end() + MOST_CHARS]) if x.start() + low <= m.start() < x.end() + low]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def fits(kind: int, span: str, digits: str) -> bool:
    """What a segment of a kind must hold; all others score minus infinity."""
    if kind == 0:
        return bool(MARKED.fullmatch(span))
    if any(map(str.isalpha, span)):
        return False
    if kind == 1:
        parts = re.split(r"[^0-9]+", span)
        return len(parts) == 4 and all(p and small(p) for p in parts)
    return (12 <= len(digits) <= 19 if kind == 2 else 7 <= len(digits) <= 15)


def features(kind: int, text: str, a: int, b: int) -> list[str]:
    """Features of text[a:b] as one segment of a kind."""
    span, k = text[a:b], KINDS[kind]
    digits = NOT_DIGIT.sub("", span)
    groups = "-".join(str(len(x)) for x in re.findall(r"[0-9]+", span)[:8])
    before = text[max(0, a - 30) : a].lower()
    seps = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", span))))
    out = [f"{k}", f"{k} groups {groups}", f"{k} seps {seps}", f"{k} digits {len(digits)}"]
    out.append(f"{k} cue {any(c in before for c in CUES[kind])}")
    out.append(f"{k} any cue {any(c in before for i in CUES for c in CUES[i] if i != kind)}")
    if kind == 0:
        out += [f"{k} marker {bool(re.search(r'[(@\[{]', span))}", f"{k} dot {bool(re.search(r'dot', span, re.I))}", f"{k} domain {bool(TOP.search(span))}", f"{k} cut {a > 0 and text[a - 1] in '._%+-'}", f"{k} sentence {'. ' in span}", f"{k} plain {' at ' in span and '.' in span} {out[4]}"]
    if kind == 2:
        out.append(f"{k} luhn {luhn(digits)}")
    if kind == 3:
        out += [f"{k} first {span[0] if not span[0].isdigit() else '0' if span[0] == '0' else '9'}", f"{k} grouped {len(re.findall('[0-9]+', span)) >= 3}", f"{k} paren {bool(re.match(r'[(+]', span))}"]
    return out


def lattice(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Tokens of text[a:b], and the segments (first token, token after the last, kind) that can score.

    What a kind must hold is known from running counts of digits, letters and runs of digits, so a segment that can't score costs nothing
    but a comparison, and fits() decides only where it can still fail.
    """
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]
    n = len(tokens)
    digits, letters, runs = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    opens, closes = [False] * n, [False] * n
    for i, (s, e) in enumerate(tokens):
        number, letter = "0" <= text[s] <= "9", text[s].isalpha()
        digits[i + 1], letters[i + 1], runs[i + 1] = digits[i] + (e - s if number else 0), letters[i] + letter, runs[i] + number
        opens[i] = not text[s].isspace() and not (s and text[s - 1].isalnum())
        closes[i] = text[e - 1].isalnum() and not (e < len(text) and text[e].isalnum())
    ends = [j + 1 for j in range(n) if closes[j]]
    out, first = [], 0
    for i, (s, _) in enumerate(tokens):
        if not opens[i]:
            continue
        while first < len(ends) and ends[first] <= i:
            first += 1
        for at in range(first, len(ends)):
            j = ends[at]
            e = tokens[j - 1][1]
            if j - i > MOST_TOKENS or e - s > MOST_CHARS:
                break
            if e - s < 7:
                continue
            d = digits[j] - digits[i]
            if letters[j] > letters[i]:
                if fits(0, text[s:e], ""):
                    out.append((i, j, 0))
                continue
            if runs[j] - runs[i] == 4 and fits(1, text[s:e], ""):
                out.append((i, j, 1))
            if 12 <= d <= 19:
                out.append((i, j, 2))
            if 7 <= d <= 15:
                out.append((i, j, 3))
    return tokens, out


class Scores:
    """Scores of segments; those of one kind and shape, behind the same cues, are added up once. What is remembered is bounded."""

    def __init__(self, w: dict[str, float], most: int = 20_000) -> None:
        self.w, self.most, self.seen = w, most, {}

    def of(self, kind: int, text: str, a: int, b: int, cues: tuple) -> float:
        span = text[a:b]
        if kind == 0:
            return sum(self.w.get(f, 0.0) for f in features(kind, text, a, b))
        digits = NOT_DIGIT.sub("", span) if kind == 2 else ""
        # features() sees of these spans: digits as such, separators, the cues, and the checksum of a card
        key = (kind, span.translate(SHAPE), span[0] == "0", cues, kind == 2 and luhn(digits))
        if (s := self.seen.get(key)) is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            s = self.seen[key] = sum(self.w.get(f, 0.0) for f in features(kind, text, a, b))
        return s


#: Digits look alike.
SHAPE = str.maketrans("0123456789", "9999999999")


def cues_before(text: str, a: int) -> tuple:
    before = text[max(0, a - 30) : a].lower()
    return tuple(any(c in before for c in CUES[k]) for k in CUES)


PLACES = ("Reach me on", "Call", "tel:", "phone", "Contact", "write to", "mail", "card number", "pay with visa", "server", "host", "from", "the", "and", "see", "version", "page", "on", "order", "id", "total", "of")


def _number(r: random.Random, n: int) -> str:
    return str(r.randrange(1, 10)) + "".join(str(r.randrange(10)) for _ in range(n - 1))


def _card(r: random.Random) -> str:
    head = _number(r, 15)
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def examples(seed: int = 7, n: int = 900) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training sentences made from templates: half hold a span, half a look-alike."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("aeiourtnshdlmk") for _ in range(r.randrange(3, 8)))
    for _ in range(n):
        d = lambda m: _number(r, m)
        kind = r.choice((0, 1, 2, 3, 3, None, None, None))
        cue = r.choice(PLACES if kind is None else [*PLACES[7:9], "the", "with"] if kind == 2 else [*PLACES[9:13]] if kind == 1 else [*PLACES[:5], "and", "on"] if kind == 3 else [*PLACES[4:7], "the", "from"])
        if kind == 0:
            at, dot = r.choice(((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), ("@", "."), ("{at}", "{dot}"), (" @ ", ".")))
            span = word() + r.choice(("", ".", "_", str(r.randrange(100)))) + word() + at + word() + dot + r.choice(("com", "org", "net", "de", "fr"))
        elif kind == 1:
            span = r.choice((".", "[.]", "(.)", "[.]")).join(str(r.randrange(1, 256)) for _ in range(4))
        elif kind == 2:
            c, s = _card(r), r.choice((" ", "-", ".", "", "/"))
            span = s.join(c[i : i + 4] for i in range(0, 16, 4))
        elif kind == 3:
            span = r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{r.randrange(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(6)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}"))
        else:
            span = r.choice((f"20{d(2)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}", f"{r.randrange(10, 29)}.{r.randrange(10, 13)}.20{d(2)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(8)}", f"{d(10)}", f"{d(16)}", f"{d(12)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)}.{d(3)}.{d(3)}", f"{word()} at {word()} dot", f"{word()} at {word()} dot {word()}", f"{word()} at {word()} dot {word()}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)} - {d(4)}", f"({d(4)}) {d(4)}", f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", f"{d(7)}", f"{d(3)} {d(4)}", f"{d(5)}/{d(5)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(6)} {d(6)}", f"{d(1)} {d(2)} {d(3)} {d(1)} {d(2)}"))
        head = f"{word()} {cue} "
        text = head + span + r.choice((".", " ", ", ")) + word()
        if kind == 2 and not luhn(NOT_DIGIT.sub("", span)):
            continue
        if kind is None and luhn(NOT_DIGIT.sub("", span)) and 12 <= len(NOT_DIGIT.sub("", span)) <= 19:
            continue
        out.append((text, [] if kind is None else [(len(head), kind, len(head) + len(span))]))
    for _ in range(n // 5):  # a word or sign for "at" beside a plain dot, and sentences that end or meet there
        a, b, c, mark = word(), word(), word(), r.choice((" at ", " at ", "@"))
        good = r.random() < 0.5
        dot = (" ." if mark == "@" else r.choice((".", ".", " ."))) if good else r.choice((". ", ". ", " . ") if mark == "@" else (". ", ". ", "."))
        span = a + mark + b + dot + (r.choice(("com", "org", "net", "de", "fr")) if good else r.choice((c, c.title(), "It", "it", "De", "Es") if " " in dot else (c, c.title())))
        cued = r.random() < 0.5 if good and mark == " at " else True
        head = f"{word()} {r.choice(PLACES[4:7] if good and cued else ('the', 'from', 'and', 'see') if good else PLACES)} "
        good &= cued  # "read at example.com" is a place, "mail jane at example.com" is not
        out.append((head + span + r.choice((".", " ", ", ")) + word(), [(len(head), 0, len(head) + len(span))] if good else []))
    return out


@functools.lru_cache(1)
def train(seed: int = 7, rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> dict[str, float]:
    """Feature weights by stochastic gradient ascent on the conditional log-likelihood of segmentations (forward-backward over segment ends).

    One-token segments of no kind score 0, so weights are relative to them.
    """
    data = []
    for text, gold in examples(seed):
        for a, b in regions(text):
            tokens, segments = lattice(text, a, b)
            if segments:
                named = [features(k, text, tokens[i][0], tokens[j - 1][1]) for i, j, k in segments]
                right = [(tokens[i][0], k, tokens[j - 1][1]) in gold for i, j, k in segments]
                data.append((len(tokens), segments, named, right))
    w: dict[str, float] = {}
    r = random.Random(seed)
    for step in range(rounds):
        r.shuffle(data)
        eta = rate / (1 + step)
        for n, segments, named, right in data:
            score = [sum(w.get(f, 0.0) for f in fs) for fs in named]
            ahead, behind = _sums(n, segments, score)
            for (i, j, _), s, fs, ok in zip(segments, score, named, right, strict=True):
                gain = eta * (ok - math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n])))
                if abs(gain) > 1e-9:
                    for f in fs:
                        w[f] = w.get(f, 0.0) * (1 - eta * decay) + gain
    return {k: round(v, 4) for k, v in sorted(w.items())}


def _sums(n: int, segments: list[tuple[int, int, int]], score: list[float]) -> tuple[list[float], list[float]]:
    """Log-sums over segmentations of the tokens before, and from, each place."""
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    ends: dict[int, list[tuple[int, float]]] = {}
    starts: dict[int, list[tuple[int, float]]] = {}
    for (i, j, _), s in zip(segments, score, strict=True):
        ends.setdefault(j, []).append((i, s))
        starts.setdefault(i, []).append((j, s))
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for i, s in ends.get(j, ()):
            ahead[j] = add(ahead[j], ahead[i] + s)
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for j, s in starts.get(i, ()):
            behind[i] = add(behind[i], behind[j] + s)
    return ahead, behind


def decode(text: str, a: int, b: int, w: dict[str, float], scores: Scores | None = None) -> list[tuple[int, int, int]]:
    """The best segmentation of a region, as (start, kind, end)."""
    tokens, segments = lattice(text, a, b)
    if not segments:
        return []
    scores = scores or Scores(w)
    n = len(tokens)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ends: dict[int, list] = {}
    at, cues = -1, ()
    for i, j, k in segments:
        if i != at:
            at, cues = i, cues_before(text, tokens[i][0])
        if (s := scores.of(k, text, tokens[i][0], tokens[j - 1][1], cues)) > 0:  # others never beat tokens of no kind
            ends.setdefault(j, []).append((i, k, s))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in ends.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    out, j = [], n
    while j:
        if back[j]:
            i, k = back[j]
            out.append((tokens[i][0], k, tokens[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def find(text: str, w: dict[str, float], scores: Scores | None = None) -> tuple[list, list]:
    """The base spans, and all spans: the field's too where they overlap no base span."""
    scores = scores or Scores(w)
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    more, at, until = [], 0, 0  # regions and base spans both ascend; until is where the base spans so far end
    for a, b in regions(text):
        while at < len(taken) and taken[at][0] <= a:
            until = max(until, taken[at][1])
            at += 1
        cut = max(a, until)
        while at < len(taken) and taken[at][0] < b:
            x, y = taken[at]
            if x - cut >= 7:
                more += decode(text, cut, x, w, scores)
            cut = max(cut, y)
            at += 1
        if b - cut >= 7:
            more += decode(text, cut, b, w, scores)
        until = max(until, cut)
    return base, sorted([*base, *more])


def say(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def spans_of(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of docs, then n_email, n_ip, n_card, n_phone (of the base spans), base_spans and spans, a row per row.

    Offsets are code points, the end exclusive. A null text has no spans. Very long texts are read whole, in time linear in their length.
    The weights are learned on the driver from generated sentences, so they don't depend on docs; they are a few hundred numbers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train())

    def make() -> Callable[[str], tuple]:
        w = sent.value
        scores = Scores(w)

        def each(text: str) -> tuple:
            base, every = find(text, w, scores)
            counts = [0] * 4
            for _, k, _ in base:
                counts[k] += 1
            said = say(base)
            return *counts, said, hashlib.sha256(said.encode()).hexdigest(), say(every)

        return each

    return map_texts(docs, make, "n_email long, n_ip long, n_card long, n_phone long, base_spans string, base_sha256 string, spans string", columns)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of spans that overlap one remains, named by the first."""
    merged: list[list[int]] = []
    for a, k, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([a, k, b])
    out, done = [], 0
    for a, k, b in merged:
        out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind in brackets, and n_chars (if there) to match; rows without a span stay as they are.

    Null texts stay null, empty ones empty; texts are read whole, whatever their length. Repeated rows change alike. All other columns,
    whatever their names, are passed through. An empty table gives an empty one.
    """
    w = docs.sparkSession.sparkContext.broadcast(train())
    schema, at, n = docs.schema, docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scores = Scores(w.value)
        for batch in batches:
            for part in slices(batch, at):
                texts, sizes = part.column(at).to_pylist(), part.column(n).to_pylist() if n is not None else None
                for i, t in enumerate(texts):
                    if t and (found := find(t, w.value, scores)[1]):
                        texts[i] = redact(t, found)
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if n is not None:
                    columns[n] = pa.array(sizes, part.schema.field(n).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(task(run), schema)


def has_spans(spans: Column) -> Column:
    return F.length(spans) > 0


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(documents(spark, sf_dir), ["doc_id"]).drop("base_spans")
