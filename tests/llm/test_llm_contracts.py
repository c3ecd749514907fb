"""Every operator of the package against a brute-force version on the smallest tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import connect, rows_of_spark, rows_of_sql
from public_tokenizers import path as tokenizer_path
from tokenizers import Tokenizer

from wardlake.llm.catalogue import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def texts(folder):
    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(table["doc_id"], table["text"], strict=True))


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, folder, name):
    assert rows_of_spark(QUERIES[name](spark, folder)) == rows_of_sql(connect(folder), ORACLES[name])


def test_fingerprints(spark, folder, texts):
    rows = {r.doc_id: r for r in QUERIES["op1_fingerprints"](spark, folder).collect()}
    order, by_text = sorted(texts), collections.defaultdict(set)
    assert sorted(rows) == order
    for i, doc in enumerate(order):
        text, following = texts[doc] or "", texts[order[(i + 1) % len(order)]] or ""
        k, row = len(text) // 4, rows[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), sha(text[: len(text) - k] + following[:k]))
        by_text[text].add(row.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert np.median([r.near_edited for r in rows.values()]) > 0.6 > 0.1 > np.median([r.near_next for r in rows.values()])


def test_encoding(spark, folder, texts):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = QUERIES["op3_bpe_encoding"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        wanted = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == wanted


def test_counts(spark, folder, texts):
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = QUERIES["op4_token_counts"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 2048)


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op5_quality_classifier"](spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pandas()
    assert len(rows) == 1000
    good = labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id
    bad = labels[labels.quality == 0].doc_id
    assert np.mean([rows[d].kept for d in good]) > 0.99
    assert np.mean([rows[d].kept for d in bad]) < 0.15
    kept = sorted((r.key for r in rows.values() if r.kept), reverse=True)
    assert kept == sorted((r.key for r in rows.values()), reverse=True)[: len(kept)]


def components(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for d, s in sets.items():
        for other, n in collections.Counter(o for g in s for o in holders[g] if o > d).items():
            if 100 * n >= 80 * (len(s) + len(sets[other]) - n):
                a, b = find(d), find(other)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates(spark, folder, texts):
    rows = QUERIES["op6_jaccard_join"](spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components(texts)


def test_shards(spark, folder, texts):
    rows = QUERIES["op7_sharding"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < 40
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    share = sum(sizes.values()) / 40
    largest = max(r.size for r in rows)
    assert all(abs(sizes[s] - share) <= largest for s in range(40))


def test_scores(spark, folder, texts):
    rows = QUERIES["op8_lm_scoring"](spark, folder).collect()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    count = collections.Counter(w for d, t in tokens.items() if not held[d] for w in t)
    total, distinct = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(t), total)
        assert r.n_known == sum(w in count for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_repeats(spark, folder, texts):
    rows = QUERIES["op9_repeated_text"](spark, folder).collect()
    raw = {d: (t or "").encode() for d, t in texts.items()}
    count = collections.Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    assert len(rows) == len(raw)
    for r in rows:
        b = raw[r.doc_id]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        wanted = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted
