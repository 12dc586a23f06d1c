"""Token counts by a two-tier lookup on the map side, as the tokenizer's own library gives them.

Tier 1 is a broadcast table of pre-token -> length: the ENTRIES pre-tokens that are most frequent in the documents, as counted (on the map
side first) in a sample of whole texts chosen by hash. The sample only decides which lengths are at hand; counts don't depend on it.
Tier 2 is a cache in each worker, bounded in entries: a pre-token outside tier 1 is encoded once by the library and remembered. A
document's count is the sum over its pre-tokens, so no pre-token is ever shuffled. Texts with a special string (an added token), and texts
with a character on which the library's regular expressions and Python's differ (each character is tried once), go to the library whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readgrain.llm.common import documents, map_texts, slices, task

MAX_TOKENS = 1024
#: Entries of tier 1, and about how many documents choose them.
ENTRIES, SAMPLE = 50_000, 2_000
#: Longer pre-tokens are encoded, not remembered.
LONGEST_KEY = 128
#: From so many characters on, pre-tokens are read one by one instead of as a list.
LONG_TEXT = 1_000_000


def frequent_pieces(docs: DataFrame, pattern: str, entries: int = ENTRIES, sample: int = SAMPLE) -> list[str]:
    """The most frequent pre-tokens of about `sample` documents, those of equal counts in order."""
    part = max(1, docs.count() // sample)
    some = docs.select("text").filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0))

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa
        import regex

        pre = regex.compile(pattern)
        for batch in batches:
            for piece in slices(batch, 0):
                found: Counter = Counter()
                for t in piece.column(0).to_pylist():
                    found.update(m.group() for m in pre.finditer(t))
                names = [p for p in found if len(p) <= LONGEST_KEY]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[p] for p in names], pa.int64())], ["piece", "n"])

    counts = some.mapInArrow(task(run), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r[0] for r in counts.orderBy(F.desc("n"), "piece").limit(entries).select("piece").collect()]


def lengths(model: str, pieces: list[str]) -> dict[str, int]:
    """Tier 1: the number of tokens that the library makes of each pre-token."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(model)
    return dict(zip(pieces, (len(x.ids) for x in lib.encode_batch(pieces, add_special_tokens=False)), strict=True))


def make_counter(model: str, pattern: str, table: dict[str, int], most: int) -> Callable[[str], int]:
    """A function from a text to its number of tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import regex
    from tokenizers import Tokenizer

    lib, pre = Tokenizer.from_str(model), regex.compile(pattern)
    lib.no_truncation()
    lib.no_padding()
    special = [t.content for t in lib.get_added_tokens_decoder().values()]
    split = lib.pre_tokenizer.pre_tokenize_str

    def whole(text: str) -> int:
        return len(lib.encode(text, add_special_tokens=False).ids)

    alike: set[str] = set()  # characters on which the two regular-expression engines agree, and on which they don't
    other: set[str] = set()

    def check(new: set[str]) -> None:
        for c in new:
            probe = f"a{c}b {c}{c} 1{c} .{c}\n{c}"
            (alike if [x[1] for x in split(probe)] == [m.span() for m in pre.finditer(probe)] else other).add(c)

    both = dict(table)  # tier 1 and the remembered misses in one dict: one lookup per pre-token

    def length(piece: str) -> int:
        n = both.get(piece)
        return whole(piece) if n is None else n

    def count(text: str) -> int:
        if new := set(text) - alike:
            check(new - other)
        if new and not new.isdisjoint(other) or any(s in text for s in special):
            return whole(text)
        if len(text) >= LONG_TEXT:
            return sum(length(m.group()) for m in pre.finditer(text))
        pieces = pre.findall(text)
        if missed := set(pieces).difference(both):
            if len(both) > len(table) + most:
                both.clear()
                both.update(table)
                missed = set(pieces).difference(both)
            missed = [p for p in missed if len(p) <= LONGEST_KEY]
            both.update(zip(missed, map(len, lib.encode_batch_fast(missed, add_special_tokens=False)), strict=True))
        try:
            return sum(map(both.__getitem__, pieces))
        except KeyError:  # pre-tokens too long to be remembered
            return sum(map(length, pieces))

    return count


def count_tokens(docs: DataFrame, model_path: str, pattern: str, columns: list[str], max_tokens: int = MAX_TOKENS, most: int = 400_000) -> DataFrame:
    """`columns` of docs, then n_bytes (UTF-8), n_tokens and over_limit, a row per row.

    A null text counts as empty: 0 bytes, 0 tokens. Very long texts are counted whole. Repeated rows give repeated results, an empty table
    an empty one. `most` bounds the entries that a worker remembers; the results don't depend on it.
    """
    with open(model_path, encoding="utf-8") as f:
        model = f.read()
    # at most ENTRIES pre-tokens of LONGEST_KEY characters
    sent = docs.sparkSession.sparkContext.broadcast((model, lengths(model, frequent_pieces(docs, pattern))))

    def make() -> Callable[[str], tuple]:
        own_model, table = sent.value
        count = make_counter(own_model, pattern, table, most)

        def each(text: str) -> tuple:
            n = count(text)
            return len(text.encode("utf-8")), n, n > max_tokens

        return each

    return map_texts(docs, make, "n_bytes long, n_tokens long, over_limit boolean", columns)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, ["doc_id"])
