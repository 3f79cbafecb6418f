"""Alignment, lexical search and substring deduplication against brute force on small fixtures."""

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.llm import alignment, lexical, near_dedup, repeats
from factorloom.llm.common import WORD, bound_batches, byte_count, scratch_dir

VOCABULARY = "ta re mi so la do fa ut quint terz prim".split()
ODD = [None, "", " ", "\n\n", " lead", "trail ", "a  b", "a\n\nb\n c", "don't 'store it's", "1.5 2,000 e.g.", "<|endoftext|> <s> x </s>", "Ünïcode naïve", "日本語 テスト",
       "under▁score", "x\x00y", "\U0001f600 \U0001f600", "tab\tand\x0bmore\x0c", "nb sp", "A" * 900 + " tail"]


def _words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"{VOCABULARY[i]}{j}" for i, j in zip(rng.integers(0, 11, n), rng.integers(0, 30, n), strict=True)]


@pytest.fixture(scope="module")
def texts():
    """Odd texts, copies, passages inside others, periodic text, a long one; ids with gaps, a null and a repeated id."""
    base, other = _words(1, 300), _words(2, 200)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(40, " ".join(base)), (30, " ".join(base)), (41, " ".join(other[:50] + base[100:160] + other[50:])), (35, "\n".join(base[110:140]))]
    rows += [(50 + k, " ".join(base[:k] + ["edit"] + base[k + 1 :])) for k in (5, 19, 20, 100, 150)]
    rows += [(60, " ".join(["go"] * 70)), (61, " ".join(["go"] * 19)), (62, " ".join(["go", "on"] * 30)), (63, " ".join(other[:19])), (64, " ".join(other[:20]))]
    rows += [(70, " ".join(_words(5, 9000) + base[:40])), (71, " ".join(base[:30] + base[:30])), (None, " ".join(base[5:40])), (72, " ".join(other)), (72, " ".join(other))]
    return rows


@pytest.fixture(scope="module")
def documents(spark, texts):
    data = [(i, t, "clash", 1, 2) for i, t in texts]
    return spark.createDataFrame(data, "doc_id long, text string, print string, score int, key int").repartition(3)


def _grouped(a_bytes, b_bytes, a, b):
    """Groups and links by all pairs of byte ranges."""
    spans = []
    for tokens in (a_bytes, b_bytes):
        at, own = 0, []
        for t in tokens:
            own.append((at, at + len(t)))
            at += len(t)
        spans.append(own)
    links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if s < y and x < e]
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    side = lambda own, ids, lo, hi: ",".join(str(k) for k, (s, e) in zip(ids, own, strict=True) if lo <= s and e <= hi)
    groups = [side(spans[0], a, lo, hi) + "|" + side(spans[1], b, lo, hi) for lo, hi in zip([0, *ends], ends, strict=False)]
    return groups, [(a[i], b[j]) for i, j in links]


def _brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    paths = alignment.default_tokenizers()
    tok, pieces = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    tok.encode_special_tokens = True
    letters = alignment._byte_letters()
    found = []
    for _, text in rows:
        if not text:
            found.append(([], [], [], []))
            continue
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        a_bytes = [bytes(letters.index(c) for c in tok.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
        data = (" " + text).encode()
        found.append((a, b, *_grouped(a_bytes, b_bytes, a, b)) if b"".join(a_bytes) == data == b"".join(b_bytes) else ([], [], [], []))
    docs = Counter(p for f in found for p in set(f[3]))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(n, most.get(a, 0))
    return Counter(
        (i, len(a), len(b), len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for (i, _), (a, b, groups, links) in zip(rows, found, strict=True)
    )


@pytest.mark.parametrize("frequent", [1 << 20, 20, 0])
def test_alignment_equals_all_pairs_of_ranges(documents, texts, frequent):
    short = [(i, t if t is None else t[:2500]) for i, t in texts]
    docs = documents.withColumn("text", F.substring("text", 1, 2500))
    got = alignment.align_tokenizers(docs, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == _brute_alignment(short)


def test_alignment_keeps_groups_and_takes_no_rows(spark, documents):
    rows = alignment.align_tokenizers(documents, with_groups=True).where("n_a > 0").collect()
    assert rows and all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in rows)
    assert alignment.align_tokenizers(documents.limit(0)).count() == 0


def test_components_are_the_groups_between_common_ends():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = int(rng.integers(1, 30))
        a, b = (sorted({*rng.integers(1, size + 1, 8).tolist(), size}) for _ in range(2))
        links, groups = alignment.components(a, b)
        spans = [list(zip([0, *e], e, strict=False)) for e in (a, b)]
        assert set(links) == {(i, j) for i, (s, e) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if s < y and x < e}
        cuts = sorted(set(a) & set(b))
        ends = [max(([*a, *b])[x] for x in g) for g in groups]
        assert ends == cuts and sorted(x for g in groups for x in g) == list(range(len(a) + len(b)))


def _brute_repeats(rows, window):
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen, out = {}, {}
    for key in order:  # documents that share an id are told apart by their texts below
        words = re.findall(WORD, key[2])
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.setdefault(w, (key, s))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[key] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return [(i, *out[(i is not None, i or 0, t or "")]) for i, t in rows]


@pytest.mark.parametrize("window, seed", [(20, 8), (6, 3), (5, 5)])
def test_substring_dedup_equals_all_windows(documents, texts, window, seed, monkeypatch):
    monkeypatch.setattr(repeats, "PART_ROWS", 200)  # many range partitions, so that groups cross their edges
    got = repeats.remove_repeats(documents, window, seed, with_text=True)
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
    want = _brute_repeats(texts, window)
    assert Counter(rows) == Counter(w[:4] for w in want)
    assert all(r.kept_text is None or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_substring_dedup_of_a_large_group(spark):
    """Near copies with edits of their own, so that an anchor has many classes."""
    rng, base = np.random.default_rng(9), _words(8, 120)
    rows = []
    for i in range(300):
        copy = list(base)
        for k in rng.integers(0, 120, 3):
            copy[k] = f"own{i}x{k}"
        rows.append((i, " ".join(copy[: rng.integers(30, 120)])))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == Counter(w[:4] for w in _brute_repeats(rows, 20))
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _brute_search(rows, items, k):
    docs = [(i, re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df, out = Counter(t for _, c, _ in docs for t in c), []
    for item, text in items:
        terms = re.findall(lexical.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        scored = []
        for i, counts, n in docs:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in terms if t in counts)
            if score:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return Counter(out)


@pytest.mark.parametrize("block_docs, max_queries, k", [(128, 1024, 20), (3, 2, 4), (1, 1024, 20)])
def test_search_equals_scoring_everything(spark, documents, texts, block_docs, max_queries, k):
    items = [(7, "quint1 QUINT2 go on"), (7, "terz3 terz3 edit"), (8, None), (9, ""), (10, "nowhere"), (11, "Ünïcode 日本語 x"), (None, "go"), (12, " ".join(_words(1, 60)))]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = lexical.search(documents, table, k, seed_blocks=2, max_queries=max_queries, block_docs=block_docs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == _brute_search(texts, items, k)


def test_search_of_nothing(spark, documents):
    nothing = documents.limit(0)
    items = spark.createDataFrame([(1, "go")], "item_id long, text string")
    assert lexical.search(nothing, items).count() == 0 and lexical.search(documents, items.limit(0)).count() == 0
    assert lexical.search(documents.where("text is null"), items).count() == 0


def test_sizes_of_settings(spark):
    assert [byte_count(t) for t in ("64m", "1GB", "8388608", "512kib", "100b")] == [64 << 20, 1 << 30, 8388608, 512 << 10, 100]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        bound_batches(spark)
        assert byte_count(spark.conf.get(key)) == 8 << 20
    finally:
        spark.conf.set(key, before)


def test_search_reads_few_blocks_at_a_time(spark, monkeypatch):
    """Rows of the index are whole blocks: jobs that read them hold few in a reader, and the session's own setting comes back."""
    key, seen = "spark.sql.parquet.columnarReaderBatchSize", {}
    before, write = spark.conf.get(key), lexical.materialize

    def noted(df, label, rows=None):
        seen[label] = int(spark.conf.get(key))
        return write(df, label, rows)

    monkeypatch.setattr(lexical, "materialize", noted)
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 3} x") for k in range(40)], "doc_id long, text string")
    found = lexical.search(docs, spark.createDataFrame([(1, "w1 w2")], "item_id long, text string"), k=3, block_docs=4).collect()
    assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == [1, 2, 3]
    assert {seen[label] for label in ("block-max", "seeded", "ranked")} == {lexical.READ_BLOCKS} and spark.conf.get(key) == before


def test_near_duplicates_keep_no_sketches_of_pairs(spark):
    """Tables that only one call of the pair tests reads are deleted as soon as it ends; links that it found stay."""
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(k, " ".join(words[k % 3 :] if k < 6 else [f"{k}x{j}" for j in range(9)])) for k in range(9)], "doc_id long, text string")
    tables = lambda: {p.name for p in Path(scratch_dir(spark).removeprefix("file://")).iterdir()}
    before = tables()
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, size=2).collect()}
    assert found == {k: 0 if k < 6 else k for k in range(9)}
    left = {name[:-33] for name in tables() - before}
    assert "sketches" in left and not left & {"pairs", "pairs-sketches", "pairs-sets", "values"}
