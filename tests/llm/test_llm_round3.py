"""Exact dedup, conversation repair and whitening against brute force and on odd inputs."""

import base64
import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, rows_of_spark, rows_of_sql
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from test_llm_edges import ROWS, brute, table
from tokenizers import Tokenizer

from wardlake.llm import encode, exact, fingerprints, lm, neighbours, quality, repair, repeats, vec, whiten
from wardlake.llm.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op6_jaccard_join", "op7_sharding", "op9_repeated_text", "op12_conversation_repair", "op13_exact_dedup"])
def test_same_as_sql(spark, folder, name):
    columns, rows = rows_of_spark(QUERIES[name](spark, folder))
    wanted_columns, wanted = rows_of_sql(connect(folder), ORACLES[name])
    assert columns == wanted_columns and rows == wanted and rows


# Exact dedup


def groups_by_hand(rows):
    out = []
    for doc_id, text in rows:
        same = [d for d, t in rows if (t or "") == (text or "")]
        ids = [d for d in same if d is not None]
        out.append((doc_id, max(ids, default=None), len(same), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def weak(text):
    """Four hashes for all texts: every group holds collisions."""
    return F.hex(F.crc32(text.cast("binary")) % 4).cast("binary")


@pytest.mark.parametrize("hashed", [exact.content_hash, weak])
def test_exact_groups(spark, hashed):
    more = [(100 + i, "the same text in a third of all rows") for i in range(400)] + [(None, ""), (None, "only without an id"), (None, "only without an id")]
    rows = ROWS + more
    got = exact.exact_groups(table(spark, rows), hashed=hashed).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == groups_by_hand(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_of_nothing_and_normalised(spark):
    assert exact.exact_groups(table(spark, [])).collect() == []
    got = exact.exact_groups(table(spark, ROWS), normalise=lambda t: F.lower(F.trim(t)))
    assert {r.doc_id: r.keep_id for r in got.collect() if r.doc_id in (10, 11, 1, 9)} == {10: 11, 11: 11, 1: 9, 9: 9}


def test_distinct_texts_keep_whole_rows(spark):
    rows = ROWS + [(3, ""), (8, None)]
    docs = table(spark, rows)
    left = exact.distinct_texts(docs)
    assert left.columns == docs.columns
    want = {t or "": max((d for d, u in rows if (u or "") == (t or "") and d is not None), default=None) for _, t in rows}
    assert {r.text or "": r.doc_id for r in left.collect()} == want and left.count() == len(want)


def test_exact_dedup_is_native(spark, folder):
    plan = QUERIES["op13_exact_dedup"](spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExternalRDD"))


def test_only_repeated_hashes_move_texts(spark):
    rows = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("hash"), "id")
    few = exact.bitmap_of(rows.where("id < 10"))
    assert few.count() <= 10 and exact.among(rows, few).where("id < 10").count() == 10
    assert exact.among(rows, few).count() <= 12


# Conversation repair


def all_repairs(rows):
    """Costs of every legal audit with few inserts, by trying them all."""
    best = None
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def walk(i, last, cost, audit):
        nonlocal best
        if best is not None and (cost > best[0]):
            return
        if i == len(rows) and last in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        if audit[-3:] != "III":
            walk(i, "a" if last == "u" else "u", cost + 3, audit + "I")
        if i == len(rows):
            return
        initial, fault = rows[i]
        late = 3 if fault == "truncated" else 0
        if fault not in ("blank", "duplicate"):
            if initial in after[last]:
                walk(i + 1, initial, cost + late, audit + "K")
            walk(i + 1, "a" if last == "u" else "u", cost + 3 + late, audit + "R")
        walk(i + 1, last, cost + 4, audit + "D")

    walk(0, "", 0, "")
    return best


def test_edits_are_cheapest_and_least():
    pick = random.Random(3)
    for _ in range(300):
        rows = [(pick.choice("sua?"), pick.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(pick.randint(0, 6))]
        symbols = bytes(4 * "sua?".index(i) + repair.FAULTS.index(f) for i, f in rows)
        letters = repair.edits(symbols, repair.START, repair.TAIL_COST)
        state = repair.START
        for symbol, each in zip(symbols, letters, strict=True):
            state = next(q for q in range(4) if (w := repair.steps(symbol)[state][q]) and w[1] == each)
        audit = "".join(letters) + repair.TAIL[state]
        cost, order = repair.forward(symbols, repair.START)
        assert (min(c + t for c, t in zip(cost, repair.TAIL_COST, strict=True)), audit) == all_repairs(rows), rows


def test_tables_of_parts_meet_as_the_whole():
    pick = random.Random(4)
    for _ in range(200):
        symbols = bytes(pick.randrange(16) for _ in range(pick.randint(2, 12)))
        cut = sorted(pick.sample(range(1, len(symbols)), pick.randint(1, len(symbols) - 1)))
        parts = [symbols[a:b] for a, b in itertools.pairwise([0, *cut, len(symbols)])]
        assert repair.joined([repair.summary(p) for p in parts]) == repair.summary(symbols)
        ends = repair.crossings([repair.summary(p) for p in parts], repair.START, None)
        got, begin = [], repair.START
        for i, (part, end) in enumerate(zip(parts, ends, strict=True)):
            after = repair.TAIL_COST if i == len(parts) - 1 else [0 if c == end else repair.INF for c in range(4)]
            got += repair.edits(part, begin, after)
            begin = end
        assert got == repair.edits(symbols, repair.START, repair.TAIL_COST)


CHATS = "conv_id long, turn long, role string, text string, place long, block long, letters int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CHATS)


def repaired(done):
    sums = {r.conv_id: r for r in done.conversations().collect()}
    turns = {}
    for r in sorted(done.rows().collect(), key=lambda r: (r.place, r.step)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    shas = {r.conv_id: r.sha256 for r in repair.digests(done.rows()).collect()}
    assert shas == {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in turns.items()}
    return sums, turns


def test_repair_of_odd_conversations(spark):
    long_text = "many words here. " * 20_000
    rows = [
        (1, 0, "system", "Be good."), (1, 1, "user", "Hi?"), (1, 2, "assistant", long_text),
        (2, 5, "user", "a."), (2, 5, "user", "a."), (2, 9, "assistant", "cut of"),
        (3, None, None, None), (3, None, "", " \t\n"),
        (None, 1, "assistant", "No id."), (None, 2, "user", "Ends with a question?"),
        (4, 1, "tool", "Unknown role."), (5, 1, "system", "Alone."),
    ]
    sums, turns = repaired(repair.Repair(chats(spark, rows)))
    assert (sums[1].audit, sums[1].cost, sums[1].illegal, len(turns[1])) == ("KKK", 0, 0, 3)
    assert turns[1][2] == f"assistant:{long_text}"
    two = sums[2]
    assert (two.audit, two.cost, two.gaps, two.duplicate, two.truncated, two.illegal) == ("KDK", 7, 3, 1, 1, 1)
    assert (sums[3].audit, sums[3].blank, sums[3].gaps, sums[3].illegal, 3 in turns) == ("DD", 2, 0, 1, False)
    assert (sums[None].audit, sums[None].cost) == ("IKKI", 6)
    assert (sums[4].audit, sums[4].cost) == ("D", 4) and (sums[5].audit, sums[5].cost) == ("D", 4)
    nothing = repair.Repair(chats(spark, []))
    assert nothing.conversations().collect() == nothing.rows().collect() == []


def test_long_conversations_are_cut_and_give_the_same(spark, monkeypatch):
    pick = random.Random(5)
    rows = [
        (c, t if pick.random() < 0.9 else t - 1, pick.choice(["user", "assistant", "assistant", "system", "x"]), pick.choice(["Yes.", "no", "", f"word {t}.", f"word {t}"]))
        for c, n in ((1, 700), (2, 3), (3, 40), (None, 60))
        for t in range(n)
    ]
    whole = repaired(repair.Repair(chats(spark, rows)))
    monkeypatch.setattr(repair, "PIECE_BITS", 2)
    monkeypatch.setattr(repair, "FAN_BITS", 3)
    assert repaired(repair.Repair(chats(spark, rows))) == whole
    for conv, sums in whole[0].items():
        assert sums.audit.count("K") + sums.audit.count("R") + sums.audit.count("I") == len(whole[1].get(conv, []))


# Whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, component int, part double")


def whitened(spark, rows, **options):
    return whiten.whiten(vectors(spark, [(i, e, "x", 1, 0.5) for i, e in rows]), **options).collect()


def by_numpy(rows):
    width = max(len(e) for _, e in rows)
    usable = [(i, [int(np.floor(256.0 * float(np.float32(c)))) for c in e]) for i, e in rows if len(e) == width]
    fit = np.array(sorted({tuple(x) for _, x in usable}), dtype=np.int64)
    centred = fit - fit.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / len(fit))
    return usable, fit, values[::-1], basis[:, ::-1]


@pytest.mark.parametrize(("n", "d", "kind"), [(300, 40, "flat"), (200, 30, "low rank"), (50, 3, "narrow"), (400, 25, "hot")])
def test_whitening(spark, n, d, kind):
    pick = np.random.default_rng(d)
    data = pick.standard_normal((n, d)) * (1 if kind == "flat" else np.linspace(2, 0.3, d))
    if kind == "low rank":
        data = np.floor(4 * pick.standard_normal((n, 3))) @ np.floor(3 * pick.standard_normal((3, d)))
    if kind == "hot":
        data[: n // 3] = data[0]
    rows = [(i, row.tolist()) for i, row in enumerate(data.astype(np.float32))]
    usable, fit, values, basis = by_numpy(rows)
    got = whitened(spark, rows)
    k = min(4, d, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == n * k and {r.n for r in got} == {len(fit)}
    assert max(r.identity_error for r in got) < 1e-10
    sums, mean = fit.sum(axis=0).tolist(), fit.mean(axis=0)
    scores = {(r.vec_id, r.component): r for r in got}
    for c in range(1, k + 1):
        want = [(np.array(x) - mean) @ basis[:, c - 1] / np.sqrt(values[c - 1]) for _, x in usable]
        have = [scores[i, c].whitened for i, _ in usable]
        assert min(np.abs(np.subtract(have, want)).max(), np.abs(np.add(have, want)).max()) < 1e-8
        assert abs(scores[0, c].explained - values[c - 1] / values.sum()) < 1e-12
    for i, x in usable[:20]:
        assert scores[i, 1].deviation == sum((len(fit) * a - b) ** 2 for a, b in zip(x, sums, strict=True))


def test_whitening_of_odd_vectors(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, [])]) == [] and whitened(spark, [(1, None)]) == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 3.0]), (2, [-1.0, 0.5]), (3, [0.0, None]), (4, [float("nan"), 1.0]),
        (5, [float("inf"), 1.0]), (6, None), (7, [1.0]), (8, [1e30, 0.0]), (9, [-0.0, 0.003]),
    ]
    got = whitened(spark, rows)
    assert sorted({str(r.vec_id) for r in got}) == ["1", "2", "9", "None"] and len(got) == 10 and {r.n for r in got} == {4}
    sums = [256 - 256, 768 + 128]
    assert {r.deviation for r in got if r.vec_id == 9} == {(0 - sums[0]) ** 2 + (0 - sums[1]) ** 2}


def test_deviation_that_no_long_holds():
    centre = whiten.Centre(10**6, [10**12, 0])
    x = np.array([[10**6, 10**4], [10**9, 0]], np.int64)
    assert centre.deviation(x) == [None, None]
    assert centre.deviation(np.array([[10**6, 3]], np.int64)) == [9 * 10**12]


# Sketches and names of words


def test_sketches_never_rule_out_a_link():
    pick = np.random.default_rng(9)
    for _ in range(300):
        n, m, both = (int(x) for x in pick.integers(1, 400, 3))
        both = min(n, m, both)
        pool = pick.integers(0, 1 << 63, n + m, dtype=np.uint64)
        x, y = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : n + m - both]]))
        differ = len(np.setxor1d(x, y))
        assert neighbours.apart(neighbours.parity(x), neighbours.parity(y)) <= differ
    same = np.arange(7, dtype=np.uint64) << np.uint64(40)
    assert neighbours.apart(neighbours.parity(same), neighbours.parity(same)) == 0


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_mirrored_words_are_two_words(spark):
    word = thue_morse(11)
    mirror = word.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer((word + mirror).encode(), np.uint8)
    ends = np.array([len(word), 2 * len(word)])
    one, two = vec.names(raw, ends - len(word), ends)
    assert one != two
    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, f"{word} {mirror}"), (2, f"{mirror} {word}"), (3, word), (4, mirror)], "doc_id long, text string")
    library = Tokenizer.from_file(path)
    for r in encode.decode(encode.encode(docs, path), path).collect():
        assert r.ids == library.encode(r.row.text, add_special_tokens=False).ids and r.decoded == r.row.text
    assert {r.doc_id: r.component_id for r in neighbours.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


# Repeated text


def passages(spark, copies, words=60):
    pick = random.Random(copies)
    passage = " ".join(f"shared{i}" for i in range(words))
    rows = []
    for i in range(copies):
        own = [" ".join(f"w{pick.randrange(10**9)}" for _ in range(20)) for _ in range(2)]
        rows.append((i, f"{own[0]} {passage} {own[1]}"))
    rows += [(copies + i, f"alone {pick.random()} " * 3) for i in range(20)]
    return rows


def test_a_common_passage_over_many_ranges(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(repeats, "SAMPLE", 4)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        told = []
        for copies in (150, 600):
            rows = passages(spark, copies)
            kept = {}

            class Kept(repeats.Scratch):
                def keep(self, name, df):
                    kept[name] = super().keep(name, df)
                    return kept[name]

            monkeypatch.setattr(repeats, "Scratch", Kept)
            got = {r.row.doc_id: bytes(r.kept) for r in repeats.remove_repeats(table(spark, rows)).collect()}
            assert [got[i] for i, _ in rows] == brute([t.encode() for _, t in rows])
            settled = kept["merged"].where("window IS NOT NULL")
            told.append(settled.where("copies > 1").count())
        # Windows that repeat in a range are told once, however many copies there are.
        assert told[1] <= 2 * told[0] + 1000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_text_of_several_segments(spark):
    pick = random.Random(6)
    long = " ".join(f"{pick.randrange(10**12):x}" for _ in range(440_000))
    assert len(long) > 4 << 20
    passage = " ".join(f"{pick.randrange(10**12):x}" for _ in range(40))
    cut = repeats.SEGMENT - 150
    rows = [(1, long[:cut] + passage + long[cut:]), (2, f"before {passage} after")]
    found = {r.row.doc_id: r for r in repeats.remove_repeats(table(spark, rows)).collect()}
    assert [tuple(s) for s in found[1].spans] == [(cut, cut + len(passage))] and bytes(found[1].kept).decode() == long
    assert bytes(found[2].kept) == b"before  after"


# Quality classifier


def by_hand(texts, good):
    """The importance of each text by models of the others, n-gram by n-gram."""
    slots = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        slots.append(quality.ngrams(b, np.array([0, len(b)]))[0].tolist() if len(b) else [])
    target, raw = collections.Counter(), collections.Counter()
    for s, g in zip(slots, good, strict=True):
        raw.update(s)
        target.update(s if g else [])
    share = sum(target.values()) / sum(raw.values())

    def ratio(t, r):
        return math.log((t + quality.PRIOR) / (r * share + quality.PRIOR))

    usual = sum(n * ratio(n, raw[s]) for s, n in target.items()) / sum(target.values())
    whole, without = [], []
    for s, g, t in zip(slots, good, texts, strict=True):
        own, scale = collections.Counter(s), math.sqrt(max(len(t.encode()), quality.SHORT) / quality.USUAL)
        plain = [n * (ratio(target[x], raw[x]) - usual) for x, n in own.items()]
        apart = [n * (ratio(target[x] - (n if g else 0), raw[x] - n) - usual) for x, n in own.items()]
        counts = list(own.values())
        whole.append(sum(v for v, n in zip(plain, counts, strict=True) if v / n < -quality.IGNORED) / scale)
        without.append(sum(v for v, n in zip(apart, counts, strict=True) if v / n < -quality.IGNORED) / scale)
    return whole, without


def test_importance_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = docs.join(labels, "doc_id").select("doc_id", "text", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).orderBy("doc_id").collect()
    whole, without = by_hand([r.text or "" for r in known], [r.good for r in known])
    scores = {r.doc_id: r.score for r in quality.resample(docs, labels).collect()}
    assert np.allclose([scores[r.doc_id] for r in known], whole, atol=1e-3)
    good = np.array([w for w, r in zip(without, known, strict=True) if r.good])
    others = np.array([w for w, r in zip(without, known, strict=True) if not r.good])
    assert abs(quality.Classifier(docs, labels).cut - quality.best_cut(good, others)) < 1e-3


def test_the_cut_looks_at_both_classes():
    good = np.array([-90.0, -3.0, -2.0, *np.zeros(300)])
    assert quality.best_cut(good, np.array([-50.0, -20.0, -2.5])) == -2.0  # one odd good text does not decide
    assert quality.best_cut(good, np.array([-50.0, -20.0])) == -3.0  # no more good is let go than that stops
    assert quality.best_cut(np.zeros(0), np.zeros(3)) == float("-inf") and quality.best_cut(np.array([-1.0]), np.zeros(0)) == -1.0


def test_toxic_text_is_rejected():
    import duckdb

    from wardlake.session import local_session

    spark, folder = local_session(8), "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    kept = {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    known = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{folder}/labels.parquet' JOIN '{folder}/documents.parquet' USING (doc_id)").fetchall()
    good, toxic = {d for d, q, t in known if q == 1 and not t}, {d for d, q, t in known if t}
    assert len(good - kept) <= len(good) / 50 and len(toxic & kept) <= len(toxic) / 4


# Fingerprints


def chosen_windows(texts):
    """The selected windows of each text, window by window."""
    width, terms = fingerprints.WINDOW, [round(c * math.log2(c) * 2**20) if c else 0 for c in range(fingerprints.WINDOW + 1)]
    scored, held = [], collections.Counter()
    for t in texts:
        own = [(terms[width] - sum(terms[c] for c in collections.Counter(t[i : i + width]).values())) * 1000 // terms[width] for i in range(len(t) - width + 1)]
        scored.append(own)
        held.update(own)
    order = sorted(range(fingerprints.SCORES), key=lambda s: (s == 0, held[s], s))
    rank = {s: i for i, s in enumerate(order)}
    out = []
    for t, own in zip(texts, scored, strict=True):
        keys = [(rank[s], i) for i, s in enumerate(own)]
        lowest = collections.Counter(min(keys[i : i + fingerprints.NEIGHBOURS])[1] for i in range(len(keys) - fingerprints.NEIGHBOURS + 1))
        picked = sorted(i for i, n in lowest.items() if n >= fingerprints.POPULAR and own[i] > 0)
        if not picked and keys:
            picked = [min(keys)[1]]
        out.append([t[i : i + width] for i in picked] if keys else [t] if t else [])
    return out


def filters(windows):
    """Chains of bit sets, as whole numbers."""
    chain, seen = [], []
    for w in windows:
        if w not in seen:
            if len(seen) % fingerprints.FULL == 0:
                chain.append(0)
            seen.append(w)
            raw = np.frombuffer(w, np.uint8)
            name = int(vec.span(vec.prefix(raw), np.array([0]), np.array([len(w)]))[0])
            for i in range(fingerprints.HASHES):
                chain[-1] |= 1 << (name >> 11 * i) % fingerprints.BITS
    return chain


def alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a

    def share(x, y):
        n, m = x.bit_count(), y.bit_count()
        chance = n * m / fingerprints.BITS
        return min(1.0, max(0.0, ((x & y).bit_count() - chance) / (min(n, m) - chance)))

    return sum(max(share(x, y) for y in b) for x in a) / len(a)


def test_fingerprints_against_brute_force(spark):
    pick = random.Random(8)
    words = ["".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 9))) for _ in range(60)] + ["zzzzzzzzzz", "été"]
    texts = [" ".join(pick.choices(words, k=n)) for n in (0, 1, 4, 12, 30, 80, 300, 700, 700)] + ["q" * 200, "tiny"]
    texts[8] = texts[7][:2000] + texts[8][:300]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(spark, rows)).collect()}
    own = [filters(w) for w in chosen_windows([t.encode() for t in texts])]
    assert len(own[7]) >= 1 and max(map(len, own)) < 20
    for i, chain in enumerate(own):
        raw = base64.b64decode(got[i].fingerprint)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, fingerprints.BITS)
        assert [sum(1 << int(x) for x in np.flatnonzero(row)) for row in bits] == chain
        following = own[(i + 1) % len(own)]
        # Equally long chains are compared from either side; both ways are allowed.
        assert min(abs(got[i].near_next - alike(*pair)) for pair in ((chain, following), (following, chain))) < 1e-6


def test_rows_without_an_id_spread_over_ranges(spark):
    rows = [(None if i % 3 else i, f"text number {i} of some length") for i in range(3000)]
    dealt = fingerprints.with_next(table(spark, rows), 12).where("NOT guard").groupBy(F.spark_partition_id().alias("task")).count()
    sizes = [r["count"] for r in dealt.collect()]
    assert sum(sizes) == 3000 and len(sizes) == 12 and max(sizes) <= 2 * 3000 / 12


# The language model


def test_scores_against_brute_force(spark):
    pick = random.Random(10)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(pick.choices(words, weights=[1 / (j + 1) for j in range(40)], k=pick.randint(0, 60)))) for i in range(120)] + [(500, None), (501, "Never seen")]
    got = {r.doc_id: r for r in lm.score(table(spark, texts), F.col("doc_id") % 7 != 2).collect()}
    split = {i: [*(t or "").lower().split(), "</s>"] for i, t in texts}
    pairs = {i: list(zip(["<s>", *s], s, strict=False)) for i, s in split.items()}
    trained = [i for i in split if i % 7 != 2]
    word = collections.Counter(w for i in trained for w in split[i])
    pair = collections.Counter(p for i in trained for p in pairs[i])
    context = collections.Counter(word) | collections.Counter({"<s>": len(trained)})
    total, distinct = sum(word.values()), len(word)

    def parts(c_pair, c_context, c_word, n):
        return c_pair / max(c_context, 1), c_word / max(n, 1), 1 / (distinct + 1)

    def place(c):
        return int(math.log2(c)) + 1 if c > 0 else 0

    held = collections.defaultdict(collections.Counter)
    for i in trained:
        for v, w in pairs[i]:
            p2, p1, p0 = parts(pair[v, w] - 1, context[v] - 1, word[w] - 1, total - 1)
            r = [np.rint(lm.STEP * math.log2(max(p / p0, 2.0**-60))) for p in (p2, p1)]
            held[place(context[v] - 1)][tuple(r)] += 1
    weights = collections.defaultdict(lambda: (0.0, 0.99, 0.01))
    for b, cells in held.items():
        mix = [1 / 3] * 3
        for _ in range(lm.ROUNDS):
            gained = [0.0] * 3
            for (r2, r1), n in cells.items():
                ratios = [0.0 if 2 ** (r / lm.STEP) <= 2.0**-59 else 2 ** (r / lm.STEP) for r in (r2, r1)] + [1.0]
                shares = [m * x for m, x in zip(mix, ratios, strict=True)]
                gained = [g + n * s / sum(shares) for g, s in zip(gained, shares, strict=True)]
            mix = [g / sum(cells.values()) for g in gained]
        mix = [max(m, 1e-6) for m in mix]
        weights[b] = tuple(m / sum(mix) for m in mix)
    for i, s in split.items():
        want = sum(math.log10(sum(m * p for m, p in zip(weights[place(context[v])], parts(pair[v, w], context[v], word[w], total), strict=True))) for v, w in pairs[i])
        assert abs(got[i].score - want) < 1e-6 * max(1, len(s)), i
        assert abs(got[i].base_score - sum(math.log10((word[w] + 1) / (total + distinct + 1)) for w in s)) < 1e-9 * max(1, len(s))


# Memory and exchanges


def test_anchors_of_small_batches_are_settled_together():
    text = "".join(random.Random(1).choices("abcdefghij", k=300))
    names = ["doc_id", "text_hash", "text"]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([100 + i]), pa.array([text])], names) for i in range(8)]
    out = pa.Table.from_batches(list(repeats._gather(4)(iter(batches))))
    settled = out.filter(out["text_hash"].is_valid())
    assert sorted(settled["doc_id"].to_pylist()) == list(range(8)) and len(out) - len(settled) <= 4


def test_only_texts_that_stand_for_a_shared_set_are_packed(spark, monkeypatch, tmp_path):
    words = random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=60)
    near = " ".join(words)
    alone = [" ".join(f"{w}{i}" for w in words) for i in range(40)]
    docs = spark.createDataFrame([(1, near), (2, f"{near} end"), (None, near), *((i + 10, t) for i, t in enumerate(alone))], "doc_id long, text string")
    pack, folder = neighbours._compress, str(tmp_path)

    def noted(batches):
        import uuid

        for batch in pack(batches):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(str(batch.num_rows))
            yield batch

    monkeypatch.setattr(neighbours, "_compress", noted)
    got = {r.doc_id: r.component_id for r in neighbours.near_duplicates(docs).collect()}
    assert got[1] == got[2] == 1 and got[10] == 10 and len(got) == 43
    assert 0 < sum(int(p.read_text()) for p in tmp_path.iterdir()) <= 3
