"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardlake.llm import chat, counts, decontaminate, encode, fingerprints, lm, neighbours, quality, repeats, shard

SCHEMA = "doc_id long, text string, row string, ids int, spans int, node string, part int, shard int, key double, n_chars long"
LONG = " ".join(f"word{i % 997} it{i}" for i in range(12_000))
PASSAGE = "a passage of more than two hundred bytes that several documents share, " * 4
ROWS = [
    (1, "Hello wide World of words"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (5, "another text under the id five"),
    (6, "the very same row stands here twice and is long enough " * 8),
    (6, "the very same row stands here twice and is long enough " * 8),
    (None, "no id but some text for it"),
    (7, "x1 " + PASSAGE + "y1"),
    (8, "x2 " + PASSAGE + "y2"),
    (9, "hello wide world of WORDS"),
    (10, "one"),
    (11, "ONE"),
    (12, "naïve “quotes” — ünïcödé 🙂 <|endoftext|> it's"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "r", 1, 2, "n", 3, 4, 5.0, len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


def test_fingerprints(docs, nothing):
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == len(ROWS) and fingerprints.fingerprints(nothing).collect() == []
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].fingerprint == by_id[3].fingerprint == "" and by_id[2].near_next == 1.0
    assert by_id[3].near_next < 1  # an empty text is like no other
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sorted(r.near_next for r in rows if r.doc_id == 6)[-1] == 1.0
    alone = fingerprints.fingerprints(docs.where("doc_id = 10")).collect()
    assert [(r.n_chars, r.edited, r.near_next) for r in alone] == [(3, "one", 1.0)]


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, segments int"
    rows = [
        (1, 0, "user", "a\\s#<b"),
        (1, 1, "user", "<and/></turn>\n### x:\n"),
        (1, 2, "assistant", "\\### Assistant: </turn> ok"),
        (1, 2, "assistant", "\\### Assistant: </turn> ok"),
        (2, None, None, None),
        (2, 1, "we:ird\n", "t"),
        (None, 0, "assistant", ""),
    ]
    made = chat.format_chats(spark.createDataFrame([(*r, "f", 1) for r in rows], schema))
    read = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l"), "formatted")
    got = {r.conv_id: ([tuple(t) for t in r.t], r.l, r.formatted) for r in read.collect()}
    assert got[1][:2] == ([r[2:] for r in rows[:4]], rows[2][3] * 2)
    assert got[1][2].count("### user:\n") == 1 and got[1][2].count("<and/>") == 2
    assert got[2][:2] == ([("", ""), ("we:ird\n", "t")], "")
    assert got[None][:2] == ([("assistant", "")], "")
    assert chat.format_chats(spark.createDataFrame([], schema)).collect() == []


def test_encoding(spark, docs, nothing):
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = encode.decode(encode.encode(docs, path, most=20), path).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.ids == library.encode(r.row.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.row.text or "") and r.row.ids == 1
    assert encode.encode(nothing, path).collect() == []
    odd = spark.createDataFrame([(("a",), [15496, 999_999, 50256]), (("b",), None)], "row struct<text: string>, ids array<int>")
    assert [r.decoded for r in encode.decode(odd, path).collect()] == ["Hello<|endoftext|>", ""]


def test_encoding_of_odd_texts():
    from wardlake.llm import bpe, lexicon

    path = tokenizer_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.vocabulary(path)
    pool = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "\u3000", "a", "don", "LL", "9", "é", "漢字", "!", "?!", "🙂", "e\u0301", "\x00", "\x1c", "\x85", "<|endoftext|>", "z" * 60]
    pick = random.Random(5)
    for _ in range(400):
        text = "".join(pick.choice(pool) for _ in range(pick.randint(0, 30)))
        raw = np.frombuffer(text.encode(), np.uint8)
        start, end, _, kind = encode.units(raw, np.array([0, len(raw)]), own.special)
        got = [own.encode_words(raw, start[i : i + 1], end[i : i + 1])[0].tolist() if kind[i] < 0 else [int(kind[i])] for i in range(len(start))]
        assert sum(got, []) == library.encode(text, add_special_tokens=False).ids
    assert lexicon.compile_lexicon([], [])


def test_lexicon_is_minimal_and_finds_only_its_words(tmp_path):
    from wardlake.llm.lexicon import Lexicon, compile_lexicon

    words = [b"walked", b"talked", b"walks", b"talks", b"walk", b"talk", b"a"]
    (tmp_path / "l").write_bytes(compile_lexicon(words, [[i, i + 1] for i in range(len(words))]))
    found = Lexicon(str(tmp_path / "l"))
    asked = [*words, b"wal", b"walkedx", b"b"]
    flat, ends = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([len(w) for w in asked])
    place = found.find(flat, ends - [len(w) for w in asked], ends)
    assert [found.ids[found.at[p] : found.at[p + 1]].tolist() for p in place[:7]] == [[i, i + 1] for i in range(7)]
    assert place[7:].tolist() == [-1, -1, -1]
    assert len(found.final) == 7  # walk- and talk- share all that follows their first letter, and all words their end


def test_counts(docs, nothing):
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    size = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    stored = counts.prefix_counts(docs, path)
    asked = stored.select(
        "row.text",
        "n_tokens",
        counts.tokens_before(F.col("prefix_counts"), F.array(*map(F.lit, (0, 3, 7, 20, 10**6)))).alias("before"),
        counts.longest_within(F.col("prefix_counts"), F.lit(4)).alias("fits"),
    )
    rows = asked.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = r.text or ""
        assert r.n_tokens == size(text)
        if "<|" not in text:
            assert list(r.before) == [size(text[:k]) for k in (0, 3, 7, 20, 10**6)]
            assert size(text[: r.fits]) <= 4 and (r.fits == len(text) or size(text[: r.fits + 1]) > 4)
    assert counts.prefix_counts(nothing, path).collect() == []


def test_counts_at_every_prefix():
    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), counts.prefixes(path)
    for text in ("It's we're they'll o'clock 'tis", "Straße ΑΣ İstanbul ﬁne", "a1b22 !?' ''s naïve internationalization", "e\u0301te\u0301"):
        composed = counts.normal(text)[0]
        got = np.cumsum(own.table([text])[0]).tolist()
        assert got == [len(library.encode(composed[:k], add_special_tokens=False).ids) for k in range(1, len(composed) + 1)]


def labels(spark):
    schema = "doc_id long, quality int, toxic int, key double"
    rows = [(1, 1, 0), (1, 1, None), (9, 1, 0), (7, 1, 0), (8, 0, 0), (None, 1, 0), (99, 0, 1), (5, None, None)]
    return spark.createDataFrame([(*r, 0.0) for r in rows], schema)


def test_quality(spark, docs, nothing):
    rows = quality.resample(docs, labels(spark)).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 for r in rows)
    assert all(r.kept for r in quality.resample(docs, labels(spark).where("doc_id = 99")).collect())
    three = quality.resample(docs.where("doc_id != 6"), labels(spark), k=3)
    assert three.where("kept").count() == 3
    assert quality.keep_good(docs, labels(spark)).columns == docs.columns
    assert quality.resample(nothing, labels(spark)).collect() == []
    assert quality.keep_good(nothing, labels(spark)).collect() == []


def test_near_duplicates(docs, nothing):
    rows = {(r.doc_id, r.n_shingles): r.component_id for r in neighbours.near_duplicates(docs).collect()}
    assert rows[9, 1] == 1 and rows[11, 1] == 10 and rows[2, 0] == 2 and rows[4, 0] == 4
    assert rows[None, 3] is None and rows[8, max(n for d, n in rows if d == 8)] in (7, 8)
    kept = neighbours.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id or 0 for r in kept.collect()))
    assert ids.count(6) == 1 and ids.count(5) == 2 and 9 not in ids and 11 not in ids and {2, 3, 4} <= set(ids)
    assert neighbours.near_duplicates(nothing).collect() == []


def test_near_duplicates_in_a_chain(spark):
    """Texts of which only neighbours are similar are one component, whatever the first of each bucket."""
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join([f"x{j}" for j in range(i)] + base[i:]) for i in range(0, 60, 6)]
    rows = neighbours.near_duplicates(table(spark, list(enumerate(chain)))).collect()
    assert {r.component_id for r in rows} == {0}


def test_near_duplicates_in_a_large_family(spark):
    """Buckets beyond the small ones: copies near the hub, copies far from it, and pairs far from it but near each other."""
    from test_llm_contracts import components

    pick = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(pick.choice([1, 2, 4, 6, 8])):
            words[pick.randrange(150)] = f"e{i}x{pick.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(90, 102, 2):  # twins that share what sets them apart
        words = list(base)
        for j in pick.sample(range(150), 9):
            words[j] = f"t{i}x{j}"
        rows.append((i, " ".join(words)))
        words[pick.randrange(150)] = f"own{i}"
        rows.append((i + 1, " ".join(words)))
    pick.shuffle(rows)
    wanted = components(dict(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neighbours.near_duplicates(table(spark, rows)).collect()}
    assert got == wanted and len({c for _, c in wanted.values()}) > 5


def test_near_duplicates_of_texts_under_one_id(spark):
    """Different texts of one id, or of none, that share most of a passage but are under 0.8, beside rows that stand twice."""
    base = [f"w{i}" for i in range(89)]
    under = [(i, " ".join(base + [f"own{k}x{j}" for j in range(15)])) for k, i in enumerate([5, 5, None, None, None])]
    found = neighbours.near_duplicates(table(spark, under)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found) == [(0, 100, 0)] * 3 + [(5, 100, 5)] * 2
    assert sorted(r.text for r in neighbours.one_of_each(table(spark, under)).collect()) == sorted(t for _, t in under)
    # A text with one word more does link, and rows that stand twice are one.
    copies = [(7, under[0][1] + " more"), *[under[2]] * 2]
    found = neighbours.near_duplicates(table(spark, under + copies)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0)] * 5 + [(5, 5)] * 2 + [(7, 5)]
    kept = [(r.doc_id, r.text) for r in neighbours.one_of_each(table(spark, under + copies)).collect()]
    assert sorted(kept, key=str) == sorted(under, key=str)


def test_shards(docs, nothing):
    rows = shard.shards(docs, 3).collect()
    assert len(rows) == len(ROWS) and {r.shard for r in rows} <= {0, 1, 2}
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {16}
    assert shard.shards(nothing, 3).collect() == []


def test_scores(docs, nothing):
    rows = lm.score(docs, F.col("doc_id") < 9).collect()
    assert len(rows) == len(ROWS)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert sum(r.trained for r in rows) == 10 and all(r.score <= 0 for r in rows)
    untrained = lm.score(docs, F.lit(False)).collect()
    assert all(r.score == pytest.approx(0) and r.n_known == 0 for r in untrained)
    assert lm.score(nothing, F.lit(True)).collect() == []


def test_repeats(docs, nothing):
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = (r.row.text or "").encode()
        if r.row.doc_id == 6:
            assert r.kept == b"" and [tuple(s) for s in r.spans] == [(0, len(text))]
        if r.row.doc_id in (7, 8):
            assert r.kept in (b"x1y1", b"x2y2", b"x1 y1", b"x2 y2", b"x1y", b"x") or len(r.kept) < 8
        if r.row.doc_id in (1, 2, 3, 4):
            assert (r.kept, r.spans) == (text, [])
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()}[2] is None
    assert repeats.remove_repeats(nothing).collect() == []


def test_merge_keeps_order_and_prefixes():
    pick = random.Random(3)
    runs = []
    for _ in range(5):
        keys = sorted({bytes(pick.choice(b"ab") for _ in range(pick.randint(1, 12))) for _ in range(40)})
        runs.append((keys, repeats.front_code(keys)))
    merged = list(repeats.merge(runs))
    assert [m[0] for m in merged] == sorted(k for keys, _ in runs for k in keys)
    last = merged[0][0]
    for key, known, at, place in merged[1:]:
        assert known == repeats.common(last, key, 0) and runs[at][0][place] == key
        last = key


def brute(texts):
    count = {}
    for t in texts:
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(bytes(c for c, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_in_overlaps_and_periods(spark, seed):
    """Passages cut anywhere, on either side of each other, inside one text, and periodic ones."""
    pick = random.Random(seed)
    parts = ["".join(pick.choice("abcd ") for _ in range(700)) for _ in range(3)] + ["xyz" * 150, "q" * 400, "\x00" * 300]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(pick.randint(1, 4)):
            p = pick.choice(parts)
            a = pick.randint(0, 300)
            text += p[a : a + pick.randint(120, 500)] + "".join(pick.choice("ABCD") for _ in range(pick.randint(0, 90)))
        rows.append((i, text))
    got = {r.row.doc_id: bytes(r.kept) for r in repeats.remove_repeats(table(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute([t.encode() for _, t in rows])


def test_decontamination(spark, docs, nothing):
    schema = "item_id long, text string, words string, hash long, of_doc long"
    items = [(1, "hello WIDE world of words"), (2, None), (3, ""), (4, "one"), (5, PASSAGE), (5, "not there at all in any text"), (None, "no id but some text for it")]
    benchmark = spark.createDataFrame([(*i, "w", 1, 2) for i in items], schema)
    found = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained_items(docs, benchmark).collect()}
    assert found[1, 1] == found[9, 1] == 1.0 and found[10, 4] == found[11, 4] == 1.0 and found[None, None] == 1.0
    assert {d for d, i in found if i == 5} == {7, 8} and not {i for _, i in found} & {2, 3}
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in clean.collect()) == [2, 3, 4, 5, 5, 6, 6, 12]
    assert decontaminate.contained_items(nothing, benchmark).collect() == []
    assert decontaminate.clean_documents(docs, benchmark.limit(0)).count() == len(ROWS)


def test_decontamination_of_texts_under_one_id(spark):
    """A leak removes its own row, not the others of its id or the others without one; items of one id are judged one by one."""
    leak = " ".join(f"leak{i}" for i in range(30))
    rows = [(1, f"a {leak} b"), (1, "a clean text under the id one"), (None, f"c {leak} d"), (None, "clean without an id"), (None, None), (2, "clean")]
    part = " ".join(f"leak{i}" for i in range(30)) + " " + " ".join(f"other{i}" for i in range(60))
    items = spark.createDataFrame([(1, leak), (None, leak), (None, part), (None, "not there at all in any text")], "item_id long, text string")
    clean = decontaminate.clean_documents(table(spark, rows), items).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted((r for r in rows if leak not in (r[1] or "")), key=str)
    found = decontaminate.contained_items(table(spark, rows), items).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(((d, i, 26, 26, 1.0) for d in (1, None) for i in (1, None)), key=str)


def test_native_operators_run_no_python(spark, docs):
    schema = "conv_id long, turn long, role string, text string"
    chats = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a")], schema))
    pairs = decontaminate.contained_items(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))
    for df in (chats, pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
