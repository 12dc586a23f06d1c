"""The ten operators against brute force, round trips and held-out accuracy, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from readgrain.llm import forest, langid, licences, mix, pieces, pii, quality, queries, rules, simhash, tokens

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def odd_rows():
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "été", "日本", "x", "mit", "license"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(30))), r.choice(["en", "de", None]), r.choice(["s1", "s2", None, "S"]), 1) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \n\t", "en", "s1", 3), (None, "null id", "en", "s2", 7), (103, "same", "en", "s1", 4), (103, "same", "en", "s1", 4), (103, "other", "en", "s1", 5), (104, "word " * 30000, "de", "s2", 150000)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).withColumns({"key": F.lit("k"), "size": F.lit(1), "score": F.lit("s"), "_id": F.lit(0), "h": F.lit(1), "label": F.lit("l")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mix(spark, odd, empty):
    rows = mix.mix(odd).collect()
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == collections.Counter((i, s, len(WORD.findall(t or ""))) for i, t, _, s, _ in odd_rows())
    size = {(i, s): len(WORD.findall(t or "")) for i, t, _, s, _ in odd_rows() if i not in (103, None)}
    assert all(r["size"] == size[r["doc_id"], r["source"]] for r in rows if r["doc_id"] not in (103, None))
    total = sum(r["size"] for r in rows)
    per = collections.defaultdict(list)
    for r in rows:
        per[r["source"]].append(r)
    assert abs(sum(v[0]["target"] for v in per.values()) - total) < 1e-6 * total
    for v in per.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 3 and all(r["taken"] <= 3 * r["size"] for r in v)
    assert sorted(map(str, rows)) == sorted(map(str, mix.mix(odd).collect()))
    assert mix.mix(empty).count() == 0 and mix.mix_documents(empty).count() == 0
    assert mix.mix_documents(odd).columns == odd.columns


@here
def test_mix_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.execute(f"SELECT doc_id, size, source_size, round(target, 4), taken FROM ({mix.ORACLE_SQL}) ORDER BY doc_id").fetchall()
    got = queries.QUERIES["op1_mix_sources"](spark, DATA).select("doc_id", "size", "source_size", F.round("target", 4), "taken").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_tokens(spark, odd, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    extra = ["a<|endoftext|>b", "tab\x1cx\x85y", "ਠ੎ꟍ x", "  two  spaces ", "x" * 500, "don't we'll 12345 ... \n\n\n z", "\U0001f600‍\U0001f525", "Ⅷ ² ٣"]
    df = odd.unionByName(spark.createDataFrame([(200 + i, t, "en", "s", 1) for i, t in enumerate(extra)], SCHEMA), allowMissingColumns=True)
    path = P.path("byte_bpe_50k.json")
    got = tokens.count_tokens(df, path, P.PATTERN, ["doc_id", "text"], most=5).collect()
    for r in got:
        t = r["text"] or ""
        assert r["n_tokens"] == len(lib.encode(t, add_special_tokens=False).ids), t[:40]
        assert r["n_bytes"] == len(t.encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    assert tokens.count_tokens(empty, path, P.PATTERN, ["doc_id"]).count() == 0


def test_personal_data_base():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, card, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    r = random.Random(2)
    for _ in range(5000):
        t = "".join(r.choice("a1.@+-_ 9%(4)") for _ in range(r.randrange(40)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == sorted(want), t


def test_personal_data_field(spark, odd, empty):
    w = pii.train()
    found = lambda t: pii.say(pii.find(t, w)[1])
    assert found("call (017) 555-7713 now") in ("phone:5:19", "phone:6:19")  # with or without the opening bracket
    assert found("mail joe at example dot com") and found("ip 97[.]51[.]17[.]173 ok") == "ip:3:21"
    for clean in ("on 2021-11-12", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "see pages 12 34 56 78", "1234567890123456", "no data at all dot", "978-3-1614-8410-0"):
        assert found(clean) == "", clean
    rows = pii.spans_of(odd, ["doc_id"]).collect()
    assert len(rows) == len(odd_rows()) and pii.spans_of(empty, ["doc_id"]).count() == 0
    df = spark.createDataFrame([(1, "a b@c.de d", "en", "s", 10), (2, None, "en", "s", None), (3, "clean", "en", "s", 5)], SCHEMA)
    assert [(r["text"], r["n_chars"]) for r in pii.redacted(df).orderBy("doc_id").collect()] == [("a [EMAIL] d", 11), (None, None), ("clean", 5)]


def all_segments(text, w):
    """Every segment that can score, by the definition of a segment, and its score by its features."""
    tokens, out = [m.span() for m in pii.TOKEN.finditer(text)], {}
    for i, (s, _) in enumerate(tokens):
        for j in range(i + 1, min(len(tokens), i + pii.MOST_TOKENS) + 1):
            e = tokens[j - 1][1]
            cut = text[s].isspace() or (s and text[s - 1].isalnum()) or not text[e - 1].isalnum() or (e < len(text) and text[e].isalnum())
            if not cut and 7 <= e - s <= pii.MOST_CHARS:
                span = text[s:e]
                out |= {(i, j, k): sum(w.get(f, 0.0) for f in pii.features(k, text, s, e)) for k in range(4) if pii.fits(k, span, pii.NOT_DIGIT.sub("", span))}
    return tokens, out


def test_personal_data_best_segmentation():
    """The lattice holds all segments that can score, and no other choice of them scores higher than the decoded one."""
    w, r = pii.train(), random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(["12", "345", "6", "7890", " ", "-", ".", "(", ")", "/", "[.]", "ab", "tel ", "+", " at ", "é"]) for _ in range(r.randrange(4, 16)))
        tokens, scores = all_segments(text, w)
        assert set(pii.lattice(text, 0, len(text))[1]) == set(scores), text
        best = [0.0]
        for j in range(1, len(tokens) + 1):
            best.append(max([best[j - 1], *(best[i] + s for (i, e, _), s in scores.items() if e == j)]))
        first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        got = sum(scores[first[a], last[b], k] for a, k, b in pii.decode(text, 0, len(text), w))
        assert abs(got - best[-1]) < 1e-9, text


def test_personal_data_held_out():
    """Recall and precision of all spans by kind, on sentences of another seed."""
    w = pii.train()
    right, found, gold = collections.Counter(), collections.Counter(), collections.Counter()
    for text, spans in pii.examples(99, 1500):
        every = pii.find(text, w)[1]
        found.update(k for _, k, _ in every)
        gold.update(k for _, k, _ in spans)
        right.update(k for a, k, b in every if (a, k, b) in spans)
    assert all(right[k] >= 0.9 * gold[k] and right[k] >= 0.9 * found[k] for k in range(4))


def test_personal_data_many_spans():
    """In one long region, and behind a base span over many others, the field adds no span over a base span."""
    w = pii.train()
    listed = " ".join(f"10.{i // 200}.{i % 200}.17" for i in range(300))
    mixed = " ".join(f"4111 1111 1111 1111 / 10.0.{i}.23 (017) 555-7713" for i in range(150))
    assert pii.find(listed, w)[0] == pii.find(listed, w)[1]
    for text in (listed, mixed, "_".join(f"10.11.12.{i}" for i in range(200)) + "@a.bc tel 555-123-4567"):
        base, every = pii.find(text, w)
        taken = {i for a, _, b in base for i in range(a, b)}
        more = list(every)
        for x in base:
            more.remove(x)
        assert len(base) >= 65 and not any(taken & set(range(a, b)) for a, _, b in more)
        # the same as the field over what no base span holds
        want = []
        for a, b in pii.regions(text):
            free = "".join("x" if i in taken else " " for i in range(a, b))
            want += [y for m in re.finditer(" {7,}", free) for y in pii.decode(text, a + m.start(), a + m.end(), w)]
        assert more == want


def test_personal_data_plain_dots():
    """Every address in words is in a region or over a base span; the field takes those of plain dots, not sentences."""
    r = random.Random(6)
    for _ in range(20000):
        t = "".join(r.choice(("ab", "c", " at ", "@", "(at)", " ", ".", ".", " dot ", "[dot]")) for _ in range(r.randrange(3, 10)))
        held = [*pii.regions(t), *((a, b) for a, _, b in pii.base_spans(t))]
        for m in pii.MARKED.finditer(t):
            assert any(a < m.end() and m.start() < b for a, b in held), t
    w = pii.train()
    for text, want in (("write to jane at example.com now", "email:9:28"), ("mail bob at tuxedo.org, or", "email:5:22"), ("we met at home. Then it rained", ""), ("he looked at him.Then he left", ""), ("look at this. It works", ""), ("read at example.org today", ""), ("see jane@example. Then go", "")):
        assert pii.say(pii.find(text, w)[1]) == want, text


def brute_classes(rows):
    """doc index -> class (smallest id), links, by comparing all texts."""
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[t].append(i)
    sets = {}
    for t in texts:
        w = WORD.findall(t or "")
        sets[t] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else None
    names = [t for t in texts if sets[t]]
    root, links = {t: t for t in names}, collections.Counter()

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for x in range(len(names)):
        for y in range(x):
            a, b = sets[names[x]], sets[names[y]]
            if len(a & b) >= 0.8 * len(a | b):
                links[names[x]] += 1
                links[names[y]] += 1
                root[top(names[x])] = top(names[y])
    least = {}
    for t in names:
        least[top(t)] = min([least.get(top(t), 1 << 60), *texts[t]])
    return {i: ((least[top(t)], links[t]) if sets[t] else (i, 0)) for t, v in texts.items() for i in v}


def near_rows(n=400):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    out = []
    seed = [word() for _ in range(80)]
    for i in range(n):
        k = r.random()
        if k < 0.5:  # one large group of near copies
            w = list(seed)
            for _ in range(r.randrange(4)):
                w[r.randrange(80)] = word()
            out.append(" ".join(w))
        elif k < 0.65 and out:
            out.append(r.choice(out))
        elif k < 0.75:
            out.append(" ".join(word() for _ in range(r.randrange(4))))
        else:
            out.append(" ".join(word() for _ in range(r.randrange(5, 60))))
    return list(enumerate(out))


@pytest.mark.parametrize("block", [16, 128])
def test_jaccard_join(spark, block):
    rows = near_rows()
    got = by_id(forest.join(spark.createDataFrame(rows, "doc_id long, text string"), block=block))
    want = brute_classes(rows)
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == want


def test_jaccard_odd(odd, empty):
    rows = forest.join(odd).collect()
    assert len(rows) == len(odd_rows())
    assert {r["class_id"] for r in rows if r["doc_id"] in (100, 101, 102)} == {100, 101, 102}
    assert forest.join(empty).count() == 0
    kept = forest.distinct_documents(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 103").count() == 2


def test_jaccard_at_threshold(spark):
    """Pairs at the threshold itself are found in a table whose near texts are nearly all copies."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    rows, seed = [], [word() for _ in range(200)]
    for i in range(1500):  # 45 shingles each, 40 common ones: 40 of 50
        a = [word() for _ in range(49)]
        b = [*a[:24], word(), *a[25:]]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    rows += [(3000 + i, " ".join([*seed, word()])) for i in range(300)]
    got = by_id(forest.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {i: (x["class_id"], x["n_links"]) for i, x in got.items()} == {i: (i // 2 * 2, 1) if i < 3000 else (3000, 299) for i, _ in rows}


def test_jaccard_prefixes():
    """Prefixes are as long as the near texts of the table allow: long for exact ones, shorter where they are near the threshold."""
    n = forest.TREES * forest.DEPTH
    assert forest.prefix_length({(n, 8): 50})[0] == 8
    assert forest.prefix_length({(n, 8): 50, (round(0.81 * n), 8): 50})[0] < 8 and forest.prefix_length({})[0] < 7
    assert forest.prefix_length({(n, 8): 999, (n, 5): 1})[0] == 5  # the pairs of the sample are found, too
    for likeness, length in ((0.8, 6), (0.9, 8)):
        r = random.Random(2)
        hits = sum(any(all(r.random() < likeness for _ in range(length)) for _ in range(forest.TREES)) for _ in range(2000))
        assert abs(hits / 2000 - forest.expected_recall(likeness, length)) < 0.03


@pytest.mark.parametrize("piece", [4, 1 << 16])
def test_jaccard_ties(spark, monkeypatch, piece):
    """All near texts are in one group of ties, over borders of partitions and pieces; unlike texts aren't tied because they share a prefix."""
    monkeypatch.setattr(forest, "PIECE", piece)
    rows = near_rows(250)
    sigs = forest.signatures(spark.createDataFrame(rows, "doc_id long, text string"), forest.TREES, forest.DEPTH)
    texts = sigs.filter("key IS NOT NULL").dropDuplicates(["key"]).repartition(3)
    groups = {x["node"]: x["group"] for x in forest.candidate_groups(texts, 6, 0.8, forest.TREES, forest.DEPTH).collect()}
    node = {x["doc_id"]: x["node"] for x in sigs.collect()}
    classes = collections.defaultdict(set)
    for i, (c, _) in brute_classes(rows).items():
        if node[i] is not None:
            classes[c].add(node[i])
    large = [v for v in classes.values() if len(v) > 1]
    assert all(len({groups[x] for x in v}) == 1 for v in large) and any(len(v) > 20 for v in large)
    random_text = [node[i] for i, t in rows if 0 < len(t.split()) < 60]
    assert sum(x in groups for x in random_text) < 0.05 * len(random_text) + 10 * (piece == 4)


def test_jaccard_files(spark, monkeypatch):
    """Where Spark joins no small partitions, narrow tables between steps are few files all the same."""
    from readgrain.llm import graph

    r = random.Random(8)
    texts = [[r.choice("abcdefghij") for _ in range(60)] for _ in range(80)]
    docs = spark.createDataFrame([(10 * i + k, " ".join([*t[:59], f"z{k}"]), None, None, 1) for i, t in enumerate(texts) for k in range(2)], SCHEMA).repartition(4)
    files, write = {}, forest.materialise

    def noted(df, name):
        out = write(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    for module in (forest, graph):
        monkeypatch.setattr(module, "materialise", noted)
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert sorted(x.doc_id for x in forest.distinct_documents(docs).collect()) == list(range(0, 800, 10))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 10 and {k for k, n in files.items() if n > spark.sparkContext.defaultParallelism} == {"forest-texts"}


def test_jaccard_leaders():
    """Below one trie node unlike texts are leaders of their own, untied; like ones are tied, and all that are near each other share a leader."""
    import numpy as np

    r, n = np.random.default_rng(3), forest.TREES * forest.DEPTH
    own, tied = forest.cuts(0.8, n)
    alone = r.integers(0, 2**63, (50, 4)).astype(np.uint64)
    alone[:, 3] &= np.uint64(2**32 - 1)
    part = forest.led(np.arange(50), alone, n, own, tied)
    assert len(set(part.tolist())) > 40
    assert len(set(forest.led(np.arange(50) // 25, alone, n, own, tied).tolist())) <= 2  # texts of one label are together
    flips = np.zeros((200, 4), np.uint64)
    for row in flips:
        for k in r.choice(n, r.integers(0, 20), replace=False):
            row[k // 64] ^= np.uint64(1 << int(k % 64))
    both = np.concatenate([alone[0] ^ flips, alone[1] ^ flips])
    part = forest.led(np.arange(400), both, n, own, tied)
    same = n - np.bitwise_count(both[:, None] ^ both[None]).sum(axis=2, dtype=int)
    assert all(part[i] == part[j] for i, j in zip(*np.nonzero(same >= 0.9 * n), strict=True)) and part[0] != part[200]


def test_hanging_together():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(50):
        near = r.random((12, 12)) < 0.08
        near |= near.T
        np.fill_diagonal(near, False)
        reach = np.linalg.matrix_power(near.astype(int) + np.eye(12, dtype=int), 12) > 0
        assert forest.hanging_together(near).tolist() == [int(np.nonzero(row)[0][0]) for row in reach]


@here
def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    books = langid.learn(docs)
    assert set(books) == {"en", "fr", "de", "es"} and all(langid.DICTIONARY // 2 <= len(b) <= langid.DICTIONARY for b in books.values())
    got = langid.identify(docs.filter(langid.remainder(F.col("doc_id")) == 0), books, ["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.93 * len(got)
    rows = langid.identify(odd, books, ["doc_id"]).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (100, 101, 102)} == {"und"}
    assert langid.learn(empty) == {} and langid.identify(empty, books, ["doc_id"]).count() == 0
    assert zlib.crc32(b"7") % 5 == spark.range(7, 8).select(langid.remainder(F.col("id"))).first()[0]


@here
def test_language_brute(spark):
    """Predictions and scores against compressors used one by one, over dictionaries gathered in Python."""
    import math

    import zstandard

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    own, low = collections.defaultdict(list), str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha()})
    for r in rows:
        if r["lang"] and r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            own[r["lang"]].append((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["text"].lower()))
    books = {}
    for lang, texts in own.items():
        at, kept = 0, []
        for _, t in sorted(texts)[: langid.SAMPLE_TEXTS]:
            raw = re.sub(" +", " ", t.translate(low)).encode()
            if len(raw) + 1 <= langid.DICTIONARY // 4:
                at += len(raw) + 1
                if at <= langid.DICTIONARY:
                    kept.append(raw)
        books[lang] = b"\n".join(kept)
    assert langid.learn(docs) == books
    got = by_id(langid.identify(docs, langid.learn(docs), ["doc_id"]))
    for r in rows:
        raw, size = b" ".join(r["text"].lower().translate(low).encode().split()), {}
        for lang, book in books.items():
            d = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[lang] = sum(len(c.compress(raw[i : i + langid.BLOCK])) for i in range(0, len(raw), langid.BLOCK))
        least = min(size.values())
        assert size[got[r["doc_id"]]["lang_pred"]] == least
        assert abs(got[r["doc_id"]]["score"] - 1 / sum(math.exp(-50 * (s - least) / max(1, least)) for s in size.values())) < 1e-9


def test_many_languages(spark):
    r = random.Random(2)
    rows = []
    for k in range(langid.LANGUAGES + 10):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)]
        rows += [(1000 * k + i, " ".join(r.choice(words) for _ in range(60)), f"l{k:03d}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    books = langid.learn(docs)
    assert set(books) == {x[2] for x in rows}
    assert all(x["lang"] == x["lang_pred"] for x in langid.identify(docs, books, ["lang"]).collect())


def simhash_of(t, hashed):
    """The fingerprint by its definition: each term's hashes vote for or against each bit."""
    w = t.split()
    votes = [0] * 128
    for x in zip(w, [*w[1:], None], strict=False):
        h, other = hashed[x]
        for k in range(64):
            votes[k] += 1 if h >> k & 1 else -1
            votes[64 + k] += 1 if other >> k & 1 else -1
    bits = sum(1 << k for k in range(128) if votes[k] > 0)
    return bits & (2**64 - 1), bits >> 64


def test_fingerprints(spark, odd, empty):
    """Against plain Python, with null and very frequent ids: order of documents, edited texts, fingerprints and likenesses."""
    r = random.Random(1)
    rows = [(r.choice([7, 7, 9, None, r.randrange(1000)]), " ".join(r.choice(["ab", "cd", "ef", "é"]) for _ in range(r.randrange(12))) + f" {i}") for i in range(600)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "same"), (2003, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hs = {x["text"]: x["h"] for x in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hs[x[1]]))
    texts = [t or "" for _, t in order]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, [*texts[1:], texts[0]], strict=True)]
    pairs = {x for t in texts + edited for x in zip(t.split(), [*t.split()[1:], None], strict=False)}
    found = spark.createDataFrame(list(pairs), "a string, b string").withColumn("h", F.xxhash64("a", "b")).withColumn("o", F.xxhash64("h", F.lit(1))).collect()
    hashed = {(x["a"], x["b"]): (x["h"] % 2**64, x["o"] % 2**64) for x in found}
    prints, changed = [simhash_of(t, hashed) for t in texts], [simhash_of(t, hashed) for t in edited]
    alike = lambda x, y: 1 - ((x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count()) / 128
    want = collections.Counter()
    for i, (d, _) in enumerate(order):
        want[d, len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), alike(prints[i], changed[i]), alike(prints[i], prints[(i + 1) % len(order)]), *prints[i], *changed[i]] += 1
    got = simhash.fingerprints(df).collect()
    assert collections.Counter((x["doc_id"], x["n_chars"], x["edited_sha256"], x["near_edited"], x["near_next"], *(x[c] % 2**64 for c in ("a", "b", "ea", "eb"))) for x in got) == want
    assert simhash.fingerprints(odd).count() == len(odd_rows()) and simhash.fingerprints(empty).count() == 0
    assert simhash.fingerprints(spark.createDataFrame([(5, "a b c d e f", "en", "s", 1)], SCHEMA)).first()["near_next"] == 1.0


@pytest.mark.parametrize("chunk", [16, 256])
def test_near_fingerprints(spark, empty, chunk):
    r = random.Random(3)
    base = [r.getrandbits(128) for _ in range(30)]
    every = base + [b ^ sum(1 << k for k in r.sample(range(128), r.randrange(1, 6))) for b in base for _ in range(4)]
    every += [base[0] ^ (1 << i) ^ (1 << j) for i in range(30) for j in range(i)]  # very many that share blocks
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(v & (2**64 - 1)), signed(v >> 64)) for v in every], "a long, b long")
    got = {x["a"] % 2**64 | (x["b"] % 2**64) << 64: x["n_near"] for x in simhash.count_near(prints, prints.distinct(), 3, chunk).collect()}
    assert got == {a: sum(a != b and (a ^ b).bit_count() <= 3 for b in set(every)) for a in set(every)}
    none = empty.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    assert simhash.count_near(none, none).count() == 0


@here
def test_fingerprints_query(spark):
    rows = queries.QUERIES["op6_fingerprints"](spark, DATA).collect()
    names = {int(r["fingerprint"], 16) for r in rows}
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    for r in rows:
        want = None if r["doc_id"] % simhash.SOUGHT else sum(0 < (int(r["fingerprint"], 16) ^ x).bit_count() <= simhash.RADIUS for x in names)
        assert r["n_near"] == want


def brute_rules(rows):
    """kept per row, by plain Python; rows: (id, text, lang, source)."""
    import math

    counts, values = {}, collections.defaultdict(list)
    for i, text, lang, source in rows:
        t = text or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        m = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        letters = [x for x in t if x.isascii() and x.isalpha()]
        n = {"symbols_pm": (sum(x in "#*$%&|<>" for x in t), sum(map(len, w))), "dup_lines_pm": (len(lines) - len(set(lines)), len(lines)), "repeats_pm": (len(m), len(w)), "capitals_pm": (sum(map(str.isupper, letters)), len(letters))}
        counts[i] = (n, len(w), len(m))
        for k, (a, b) in n.items():
            v = 1000 * a // max(1, b)
            shift = max(0, v.bit_length() - 7)
            for g in ((lang, source), (lang,), ()):
                values[k, g].append(v >> shift << shift)
    tail = lambda v: sorted(v)[math.ceil(len(v) * rules.TAIL - 1e-9) - 1]
    out = {}
    for i, _, lang, source in rows:
        n, words, repeated = counts[i]
        fine = words >= 10 and 100 * repeated <= 20 * words
        for k, (a, b) in n.items():
            every, by_lang, own = values[k, ()], values[k, (lang,)], values[k, (lang, source)]
            q = (len(by_lang) * tail(by_lang) + rules.DRAW * tail(every)) / (len(by_lang) + rules.DRAW)
            q = (len(own) * tail(own) + rules.DRAW * q) / (len(own) + rules.DRAW)
            allowed = rules.REACH * q / 1000 * b
            fine = fine and a - allowed <= rules.Z * math.sqrt(allowed + 1)
        out[i] = (fine, n["symbols_pm"][0], n["dup_lines_pm"][0], words, repeated, n["symbols_pm"][1])
    return out


@here
def test_rules(spark, odd, empty):
    want = brute_rules([(k, t, lang, source) for k, (_, t, lang, source, _) in enumerate(odd_rows())])
    got = rules.judge(spark.createDataFrame([(k, *x[1:]) for k, x in enumerate(odd_rows())], SCHEMA), ["doc_id"])
    seen = lambda df: {r["doc_id"]: (r["kept"], r["n_symbols"], r["n_dup_lines"], r["n_words"], r["n_repeat_words"], r["word_chars"]) for r in df.collect()}
    assert seen(got) == want
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_rules([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])
    assert seen(rules.judge(docs, ["doc_id"])) == want and 0 < sum(not w[0] and w[3] >= 10 and 5 * w[4] <= w[3] for w in want.values())
    assert rules.judge(odd, ["doc_id"]).count() == len(odd_rows()) and rules.judge(empty, ["doc_id"]).count() == 0
    long = [b"w%d" % (i * i % 9999) for i in range(20000)]
    twice = collections.Counter(tuple(long[i : i + 5]) for i in range(len(long) - 4))
    assert rules.repeated_words(long) == len({j for i in range(len(long) - 4) if twice[tuple(long[i : i + 5])] > 1 for j in range(i, i + 5)})


def test_rules_sketches(spark):
    """Sketches of two halves add up to the whole's, and sources of different distributions get different thresholds."""
    text = lambda i, marks: " ".join(f"w{i}x{j}" for j in range(60)) + " #" * (i % marks)
    df = spark.createDataFrame([(i, text(i, 3 if i % 2 else 40), "en", "plain" if i % 2 else "marked", 1) for i in range(400)], SCHEMA)
    rows = rules.judge(df, ["doc_id", "lang", "source"])
    cells = lambda r: rules.sketches(r).groupBy("g", "lang", "source", "m", "v").agg(F.sum("n").alias("n"))
    halves = rules.sketches(rows.filter("doc_id < 200")).unionByName(rules.sketches(rows.filter("doc_id >= 200")))
    merged = halves.groupBy("g", "lang", "source", "m", "v").agg(F.sum("n").alias("n"))
    assert collections.Counter(merged.collect()) == collections.Counter(cells(rows).collect())
    limit = {r["source"]: r["max_symbols_pm"] for r in rows.select("source", "max_symbols_pm").distinct().collect()}
    assert limit["marked"] > 2 * limit["plain"]


@here
def test_quality(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), quality.read_labels(spark, "/root/testdata/sf0.01")
    got = by_id(quality.scored(docs, labels, ["doc_id"]))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum((got[i]["score"] >= quality.CUT) == (q > 0) for i, q in known.items() if i in got) >= 0.97 * len(known)
    half = labels.filter("doc_id % 2 = 0")  # held-out accuracy
    other = by_id(quality.scored(docs, half, ["doc_id"]))
    held = [(other[i]["score"] >= quality.CUT) == (q > 0) for i, q in known.items() if i % 2 and i in other]
    assert sum(held) >= 0.95 * len(held)
    # the sample is the same however rows are dealt, with repeated ids too
    twice = odd.unionByName(odd.withColumn("text", F.concat(F.lit("x "), "text")))
    some = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(103, 1)], "doc_id long, quality int")
    assert quality.sample(twice.repartition(2), some) == quality.sample(twice.repartition(5), some)
    scores = [sorted(r["score"] for r in quality.scored(twice.repartition(k), some, ["doc_id"]).collect()) for k in (2, 5)]
    assert scores[0] == scores[1]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.scored(odd, none, ["doc_id"]).collect()} == {1.0}
    assert quality.scored(empty, none, ["doc_id"]).count() == 0
    assert quality.good_documents(spark, empty, DATA).count() == 0
    kept = quality.good_documents(spark, odd, "/root/testdata/sf0.001")
    assert kept.columns == odd.columns and 0 < kept.count() <= len(odd_rows())


@here
def test_quality_steps(spark):
    """The sums over all rows are those of one pass in Python, and a document's score is that of the model applied to its views."""
    import numpy as np

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), quality.read_labels(spark, DATA)
    rows = quality.sample(docs, labels)
    model = quality.cotrain(rows, docs)
    every = quality.measured(docs, model["known"], []).collect()
    x = [np.array([r[c] for r in every]) for c in ("__rg_content", "__rg_metadata")]
    told = quality.lessons(quality.measured(docs.repartition(7), model["known"], []), model["models"], 0.9)
    for v in (0, 1):
        odds = model["models"][1 - v].odds(x[1 - v])
        sure = abs(odds) >= np.log(0.9 / 0.1)
        z, y = model["models"][v].rounded(x[v][sure]), (odds[sure] > 0).astype(float)
        p = 1 / (1 + np.exp(-np.clip(z / quality.UNIT @ model["models"][v].w, -30, 30)))
        r = np.rint(quality.TAUGHT * (y - p) * quality.STEP)
        assert told[v][0] == sure.sum() and (told[v][2] == [sum(a * b for a, b in zip(z[:, k], r, strict=True)) for k in range(z.shape[1])]).all()
    got = by_id(quality.scored(docs, labels, ["doc_id"]))
    for r in docs.collect():
        content, metadata = (np.array([f]) for f in (quality.content_view(r["text"]), quality.metadata_view(r["lang"], r["source"], r["n_chars"], model["known"])))
        assert abs(quality.score_of(model, content, metadata)[0] - got[r["doc_id"]]["score"]) < 1e-9


def test_licences(spark, odd, empty):
    texts = ["Released under the MIT License. mit license mit license", "Licensed under CC BY-NC 4.0.", None, "", "GNU General\nPublic-License apache license", licences.TEMPLATES[7][1].replace("forms", "any forms at all"), "permission is hereby", "É mit ÉLICENSE"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = by_id(licences.scan(df))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        w = word.findall((t or "").translate(low))
        at = [(j, lab) for p, lab in licences.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x[1] for x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(x[0] for x in at)) if at else (None, None))
    assert got[1]["labels"] == "cc-by,cc-by-nc" and got[5]["labels"] == "bsd" and got[6]["labels"] == ""
    assert licences.scan(odd).count() == len(odd_rows()) and licences.scan(empty).count() == 0


def brute_spans(text, table):
    """Labels and places by diagonals counted in Python."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(low))
    w, out = split(text), set()
    for label, template in table:
        v = split(template)
        grams = len(v) - licences.K + 1
        lines = collections.defaultdict(list)
        for tp in range(grams):
            for p in range(len(w) - licences.K + 1):
                if w[p : p + licences.K] == v[tp : tp + licences.K]:
                    lines[p - tp].append(p)
        bands = []
        for d in sorted(lines):
            if bands and d - bands[-1][0] <= licences.GAP:
                bands[-1] = (d, bands[-1][1] + lines[d])
            else:
                bands.append((d, lines[d]))
        for _, at in bands:
            first, last = min(at), max(at) + licences.K - 1
            if len(at) >= licences.COVER * grams and len(at) >= licences.DENSE * (last - first + 2 - licences.K):
                out.add(f"{label}:{first}:{last}")
    return ",".join(sorted(out))


def test_licences_edited(spark):
    """Changed, lengthened and interleaved texts of licences, against diagonals counted one by one."""
    r = random.Random(5)
    table, texts = licences.TEMPLATES, []
    for k in range(60):
        words = " ".join(table[r.randrange(len(table))][1] for _ in range(1 + k % 2)).split()
        for _ in range(r.randrange(6)):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = [f"word{r.randrange(9)}"] * r.randrange(3)
        if k % 3 == 0:  # two licences in turns of thirty words
            other = table[r.randrange(len(table))][1].split()
            words = [x for i in range(0, max(len(words), len(other)), 30) for x in words[i : i + 30] + other[i : i + 30]]
        texts.append(f"see {' '.join(words)} end")
    got = by_id(licences.scan(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)))
    assert [got[i]["spans"] for i in range(len(texts))] == [brute_spans(t, table) for t in texts]
    assert sum(got[i]["spans"] != "" for i in range(len(texts))) > 40


def test_pieces(spark, odd, empty):
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = pieces.model_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = pieces.Codec(pieces.read_model(path))
    r = random.Random(3)
    names = list(codec.ids)
    for _ in range(3000):
        t = "".join(r.choice(names) for _ in range(r.randrange(6))).replace("▁", " ") if r.random() < 0.5 else "".join(r.choice("aehtn  \n\té日☃0123\U0001f600") for _ in range(r.randrange(40)))
        assert codec.encode(t) == lib.encode(t) and codec.decode(codec.encode(t)) == lib.decode(lib.encode(t)) == t
    rows = pieces.encode(odd, path, ["doc_id", "text"])
    assert all(x["ids"] == lib.encode(x["text"] or "") and x["round_trip"] for x in rows.collect())
    assert {(x["doc_id"], x["text"]) for x in pieces.decode(rows.drop("text"), path, ["doc_id"]).collect()} == {(i, t or "") for i, t, *_ in odd_rows()}
    assert pieces.encode(empty, path, ["doc_id"]).count() == 0 and pieces.decode(pieces.encode(empty, path, ["doc_id"]), path, ["doc_id"]).count() == 0


def test_pieces_remembered():
    """Frequent words stay in a full cache, and a word before other characters is not encoded again; ids equal the library's."""
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    seen = collections.Counter()

    class Counting(pieces.Codec):
        def _word(self, text):
            seen[text] += 1
            return super()._word(text)

    r = random.Random(7)
    codec, lib = Counting(pieces.read_model(pieces.model_path()), 400), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for _ in range(100):
        t = " ".join(r.choice(["the", "the##", "the.\nthe"]) + " " + "".join(r.choice("aeinrst") for _ in range(8)) for _ in range(30)) + r.choice(["", " ", "  x", " m².", "☃a1_b"])
        assert codec.encode(t) == lib.encode(t)
    assert seen["▁the"] == 1 and seen["▁the##"] == 0


def test_pieces_fit():
    """Two pieces are neighbours if merging their text gives them again, by the definition; also for scores that are equal or out of order."""
    r = random.Random(2)
    codecs = []
    for k in range(30):
        made = ["a", "b", "c"]
        while len(made) < 14:
            made.append(r.choice(made) + r.choice(made))
            made = list(dict.fromkeys(made))
        score = [-float(i) if k < 15 else -float(r.randrange(8)) for i in range(len(made))]
        codecs.append(pieces.Codec({"pieces": ["<unk>", *made], "scores": [0.0, *score], "kinds": [2] + [1] * len(made), "type": 2, "prefix": False, "unk": 0, "unk_surface": "?"}))
    for codec in codecs:
        for x, a in enumerate(codec.pieces[1:], 1):
            for y, b in enumerate(codec.pieces[1:], 1):
                assert codec._fits((x, y)) == (codec.merge(a + b) == [a, b])
    for codec in codecs[:15]:  # scores in the order of merges, as trained ones are
        for _ in range(200):
            t = "".join(r.choice("abc") for _ in range(r.randrange(1, 20)))
            assert codec.encode(t) == [codec.ids[p] for p in codec.merge(t)]


def test_unigram_pass():
    """The same pass with scores: the best segmentation, against all of them."""
    model = {"pieces": ["<unk>", "a", "b", "ab", "ba", "aab", "▁"], "scores": [0, -2.0, -2.5, -3.0, -2.9, -4.2, -1.0], "kinds": [2, 1, 1, 1, 1, 1, 1], "type": 1, "prefix": False, "unk": 0, "unk_surface": " ⁇ "}
    codec = pieces.Codec(model)
    score = dict(zip(model["pieces"], model["scores"], strict=True))

    def best(t):
        return 0.0 if not t else max((score[p] + best(t[len(p) :]) for p in codec.ids if t.startswith(p)), default=float("-inf"))

    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("ab") for _ in range(r.randrange(1, 9)))
        assert abs(sum(model["scores"][i] for i in codec.encode(t)) - best(t)) < 1e-9


@here
def test_pipeline(spark):
    """run() against plain Python: the classifier's model applied row by row, all pairs compared, spans cut out, the mixture filled row by row, the library's ids."""
    sentencepiece = pytest.importorskip("sentencepiece")
    import numpy as np

    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = quality.read_labels(spark, DATA)
    model = quality.cotrain(quality.sample(docs, labels), docs)
    views = lambda r: (np.array([quality.content_view(r["text"])]), np.array([quality.metadata_view(r["lang"], r["source"], r["n_chars"], model["known"])]))
    rows = {r["doc_id"]: r for r in docs.collect() if quality.score_of(model, *views(r))[0] >= quality.CUT}
    classes = brute_classes([(i, r["text"]) for i, r in rows.items()])
    w = pii.train()
    texts = {i: pii.redact(rows[i]["text"], pii.find(rows[i]["text"], w)[1]) for i, (c, _) in classes.items() if c == i}
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    by_source = collections.defaultdict(list)
    for i in texts:
        by_source[rows[i]["source"]].append((hashlib.md5(f"{i}:{hashlib.md5(texts[i].encode()).hexdigest()}".encode()).hexdigest(), i))
    names = sorted(by_source, key=lambda s: (s is None, s))
    total, weight = {s: sum(size[i] for _, i in v) for s, v in by_source.items()}, {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # those above their cap go to it, the rest share what is left
        level = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        capped = {s for s in open_ if level * weight[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in capped} if capped else {s: level * weight[s] for s in open_}
        open_ -= capped or open_
    want = collections.Counter()
    for s, v in by_source.items():
        times, left = divmod(int(target[s] + 1e-6), max(1, total[s]))
        for _, i in sorted(v):
            taken = min(left, size[i])
            want[i] = times + (taken * 2 >= max(1, size[i]))
            left -= taken
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = cp.run(spark, DATA).collect()
    assert collections.Counter(r["doc_id"] for r in got) == +want
    assert all(r["ids"] == lib.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"] and r["source"] == rows[r["doc_id"]]["source"] for r in got)


@here
def test_pipeline_stages(spark, odd, empty):
    """Every stage over odd and empty tables: columns, and rows that must stay."""
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
        out = stage(spark, odd, DATA)
        if name == "sentencepiece":
            assert out.count() == len(odd_rows())
        else:
            assert out.columns == odd.columns, name
            assert out.count() > 0, name
