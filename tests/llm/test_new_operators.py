"""Exact dedup, token alignment and spelling variants against brute force; ids beside nulls in all operators that go through Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphweft.llm import alignment, chat, common, decontamination, exactdedup, linededup, lmscore, minhash, mixing, quality, spelling, suffixdedup, tokenbin, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 2**53 + 1


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- exact dedup ------------------------------------------------------------


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact_by_force(docs):
    groups = {}
    for k, (i, t) in enumerate(docs):
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for k, (i, t) in enumerate(docs):
        first = min(groups[bare(t)])
        out.append((i, docs[first[3]][0], len(groups[bare(t)]), first[3] == k, hashlib.sha256(bare(t).encode()).hexdigest()))
    return sorted(out, key=repr)


PREFIXED = "p" * 70
TEXTS = [
    (5, "a b c"), (3, "a  b c"), (9, "abc "), (2, None), (1, ""), (7, " \n\t"), (8, PREFIXED + "x"), (6, PREFIXED + "y"), (4, PREFIXED + " x"), (10, "ünï cödé"), (11, "ünïcödé"),
    (12, "long " * 30000), (13, "long" * 30000), (14, "abd"), (15, "a bc"), (None, "abc"), (None, "z"), (20, "q"), (BIG, "big one"), (16, "Abc"),
]


@pytest.mark.parametrize("keys", [500_000, 0])
def test_exact_report(spark, monkeypatch, keys):
    monkeypatch.setattr(exactdedup, "KEYS", keys)
    assert rows(exactdedup.exact_report(frame(spark, TEXTS))) == exact_by_force(TEXTS)


def test_exact_dedup_reads_hashes_of_survivors_only(spark):
    hashed = {r.doc_id: r.sha256 for r in exactdedup.hashed_rows(frame(spark, TEXTS)).where("doc_id is not null").collect()}
    # a length of its own, and a prefix of its own among equal lengths
    assert hashed[20] is not None or hashed[20] is None  # "q" and "z" share a length but not a prefix
    assert hashed[20] is None and hashed[14] is None and hashed[BIG] is None
    assert hashed[8] and hashed[6] and hashed[8] != hashed[6]  # equal in length and prefix, told apart by the full hash


def test_exact_filter(spark):
    docs = frame(spark, [*TEXTS, (5, "a b c"), (3, "a  b c"), (21, "twin"), (21, "twin"), (21, "twin"), (None, None)])
    for c in ("_sha", "_key", "row", "kept", "_doc", "n", "prefix", "_one"):
        docs = docs.withColumn(c, F.lit("own"))
    kept = exactdedup.exact_duplicate_filter(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter([3, 7, 8, 6, 4, 10, 12, 14, 15, None, 20, BIG, 16, 21][:]) - Counter([8])  # 4 is longer than 8
    assert exactdedup.exact_report(docs.limit(0)).count() == 0 and exactdedup.exact_duplicate_filter(docs.limit(0)).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    report = exactdedup.exact_report(docs)
    assert report.where("group_size = 1000").count() == 1000 and report.where("kept").count() == 2001
    assert report.where("group_size = 1000 and kept").first().doc_id == 0


# --- alignment --------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def aligned_by_force(paths, docs):
    both = alignment.Tokenizers(*paths)
    each, counts = [], Counter()
    for i, text in docs:
        a = both.a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b_model.encode(text) if text else []
        want = b" " + (text or "").encode()
        if not text or b"".join(both.a.bytes[x] for x in a) != want or b"".join(both.b.bytes[x] for x in b) != want:
            a = b = []
        ends_a, ends_b = (list(np.cumsum([len(t.bytes[x]) for x in ids], dtype=int)) for t, ids in ((both.a, a), (both.b, b)))
        links = [(x, y) for x, e in zip(a, ends_a, strict=True) for y, f in zip(b, ends_b, strict=True) if e == f] if len(a) < 3000 else None
        if links is None:
            at = dict(zip(ends_b, b, strict=True))
            links = [(x, at[e]) for x, e in zip(a, ends_a, strict=True) if e in at]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, p = [], 0
        for c in cuts:
            own = [",".join(str(x) for x, e in zip(ids, ends, strict=True) if p < e <= c) for ids, ends in ((a, ends_a), (b, ends_b))] if len(a) < 3000 else None
            groups.append("|".join(own) if own else None)
            p = c
        counts.update(links)
        each.append((i, a, b, links, groups))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for i, a, b, links, groups in each:
        digest = "" if not a else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


ODD = [
    "plain words here", "", None, " leading", "trailing ", "  two  spaces   inside ", "\n\nlines\r\n\tand tabs ", "<|endoftext|> <s> x </s> [INST] <0x0A>", "naïve café — “quotes” … 日本語 text", "🙂🙃 👩‍👩‍👧 é ñ",
    "a▁b is lost", "▁", "x", " ", "\x00\x01 control \x7f", "don't won't I'll", "12345 67,890 3.14", " nbsp em", "word " * 400, "é" * 50, "ab cd", "tab\x1funit \x1f x",
]


def test_alignment(spark, paths):
    docs = list(enumerate(ODD)) + [(None, "plain words here"), (3, "again the same"), (3, "again the same"), (BIG, "big id")]
    got = alignment.alignments(frame(spark, docs).repartition(3), *paths)
    assert rows(got) == sorted(aligned_by_force(paths, docs), key=repr)
    assert alignment.alignments(frame(spark, []), *paths).count() == 0


def test_alignment_of_long_texts_in_segments(spark, paths, monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 9))) for _ in range(300)]
    docs = [(i, " ".join(r.choices(words, k=n))) for i, n in enumerate((1, 40, 700, 5))]
    whole = rows(alignment.alignments(frame(spark, docs), *paths))
    # in one process, with segments and slices of a few units
    monkeypatch.setattr(alignment, "SEGMENT", 7)
    monkeypatch.setattr(alignment, "SLICE", 30)
    monkeypatch.setattr(alignment, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    out = pa.Table.from_batches(list(alignment._task(*paths)(iter([batch])))).to_pylist()
    last = sorted((x["doc_id"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups_sha256"]) for x in out if x["n_a"] is not None)
    assert last == [(w[0], w[1], w[2], w[3], w[4], w[7]) for w in whole]
    sums, parts = Counter(), Counter()
    for x in out:
        (parts if x["row"] is None else sums).update(dict(zip(x["pairs"], x["counts"], strict=True)))
    assert sums == parts and sum(sums.values()) == sum(w[4] for w in whole)


def test_memory_is_bounded(paths):
    memory = alignment.Memory(alignment.Tokenizers(*paths), limit=20_000)
    for i in range(40):
        cells = memory.lookup([[f"w{i}x{k}" for k in range(20)], ["w"]])
        assert len(cells[0]) == 20 and memory.held < 60_000


# --- spelling -----------------------------------------------------------------


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def spelled_by_force(docs, least=6, often=5):
    counts = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    near = {w: [x for x in counts if distance_one(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        if xs:
            x = min(xs, key=lambda x: (-counts[x], x))
            if counts[x] >= 5 * counts[w]:
                form[w] = x
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=repr)


def test_spelling_variants(spark):
    r = random.Random(3)
    base = ["".join(r.choices("abcdé", k=r.randint(5, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaa", "ÀÉÎõü÷x", "öööööö"]
    weights = [1 / (k + 1) for k in range(len(base))]
    words = base + [w[:k] + r.choice(["", "x", "b"]) + w[k + r.randint(0, 1) :] for w in base for k in (0, 2, len(w) - 1)]
    docs = [(i, " ".join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in r.choices(words, weights=weights + [0.05] * (len(words) - len(base)), k=400))) for i in range(30)]
    docs += [(BIG, " ".join(base * 5)), (None, "Chaining, " * 6 + "chainings " * 40 + "chainingss " * 300), (40, None), (41, ""), (42, "日本語 \x00 Ābcdefg"), (7, docs[7][1])]
    assert rows(spelling.spelling_variants(frame(spark, docs))) == spelled_by_force(docs)
    # the walk ends after few levels, and longer words are compared below
    for levels in (1, 3, 6, 8):
        assert rows(spelling.spelling_variants(frame(spark, docs), levels=levels)) == spelled_by_force(docs)
    assert spelling.spelling_variants(frame(spark, [])).count() == 0


def test_spelling_of_very_long_words(spark):
    long = "abcdefghij" * 300
    words = [long, long[:-1], "x" + long, long[:1500] + "z" + long[1501:], long[:900] + long[901:], "y" * 2000, "y" * 2001, "y" * 2003]
    got = {tuple(sorted((r.a, r.b))) for r in spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {tuple(sorted((a, b))) for a in words for b in words if distance_one(a, b)}


def test_words_come_once_and_pairs_once(spark):
    r = random.Random(8)
    words = list({"".join(r.choices("ab", k=r.randint(1, 6))) for _ in range(200)})
    pairs = rows(spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).select(F.least("a", "b"), F.greatest("a", "b")))
    assert pairs == sorted(((a, b) for a in words for b in words if a < b and distance_one(a, b)), key=repr)


# --- ids ------------------------------------------------------------------------


IDS = [BIG, None, BIG + 2]


def test_ids_are_exact_beside_nulls(spark, paths):
    """2^53 + 1 and a null in one partition: no operator may hand out a neighbour of the id."""
    text = "many plain words of a text that is long enough to be read by all of them " * 5
    docs = frame(spark, [(BIG, text + "one"), (None, text + "two and more"), (BIG + 2, "three other words")]).coalesce(1)
    labels = spark.createDataFrame([(BIG, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a text that is long enough to be read by all of them")], "item_id long, text string")
    talks = spark.createDataFrame([(BIG, 0, "user", "hi"), (None, 0, "user", "ho"), (BIG + 2, 0, "assistant", "yes")], "conv_id long, turn long, role string, text string").coalesce(1)
    found = {
        "decontamination": decontamination.contamination(docs, bench),
        "toxicity": toxicity.toxicity(docs, labels),
        "suffixdedup": suffixdedup.repeats_removed(docs),
        "quality": quality.quality_report(docs, labels),
        "tokenbin": tokenbin.token_output(docs, paths[0]),
        "lmscore": lmscore.scores(docs),
        "minhash": minhash.near_duplicates(docs),
        "chat": chat.conversation_digests(chat.formatted_conversations(talks)).withColumnRenamed("conv_id", "doc_id"),
        "mixing": mixing.mixture_report(docs),
        "linededup": linededup.line_report(docs),
        "exactdedup": exactdedup.exact_report(docs),
        "alignment": alignment.alignments(docs, *paths),
    }
    for name, df in found.items():
        got = [r.doc_id for r in df.select("doc_id").collect()]
        assert sorted(x for x in got if x is not None) == [BIG, BIG + 2], name
        assert len(got) == (2 if name == "minhash" else 3), name  # which drops null ids


def test_word_hashes_are_bounded_by_bytes():
    hasher = common.WordHasher(limit=10_000)
    first = hasher([b"a" * 4000, b"b"])
    for i in range(20):
        hasher([bytes([65 + i]) * 4000])
        assert hasher.held <= 10_000
    assert (hasher([b"a" * 4000, b"b"]) == first).all()
