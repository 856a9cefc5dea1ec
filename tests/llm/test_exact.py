"""The operators that have an exact answer, against brute force or the library they must agree with."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peergraph.llm import bpe, chat, iblt, media, packing, queries, repeats, secrets, simhash

SMALL = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = [(1, "It's  naïve—don't\n\n 12345 ßé 漢字 🙂🙂  x", "a"), (2, None, None), (3, "", "b"), (4, " " * 50 + "\t\n", "c"), (5, "a" * 700, "d"), (5, "a" * 700, "d"), (6, "<|endoftext|> | || x|y z İı ſ", "e"), (None, "no id", "f")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, ids_le string").withColumnRenamed("ids_le", "part")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(frame):
    return [(r.doc_id, r.text or "") for r in frame.collect()]


@pytest.mark.parametrize("head", [0, 300, bpe.HEAD])
def test_bpe_agrees_with_the_library(spark, odd, docs, head):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    encoded = bpe.encode(both, RANKS, P.PATTERN, head=head)
    found = bpe.decode(encoded, RANKS).select("doc_id", bpe.ids("ids_le").alias("ids"), "decoded").collect()
    want = Counter((i, tuple(library.encode_ordinary(t)), t.encode()) for i, t in texts(both))
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found) == want
    assert bpe.encode(both.limit(0), RANKS, P.PATTERN, head=head).count() == 0


def test_bpe_decodes_in_the_same_stage(odd):
    rows = bpe.encode(odd, RANKS, P.PATTERN, head=0, decoded="back").join(odd.select("doc_id", "text"), "doc_id").collect()
    assert rows and all(bytes(r.back).decode() == (r.text or "") for r in rows)


def test_ascii_texts_have_a_pattern_of_their_own(docs):
    import regex

    whole = regex.compile(P.PATTERN).findall
    some = [chr(a) + chr(b) for a in range(128) for b in range(128)] + [" ".join(map(chr, range(128))), *[t for _, t in texts(docs) if t.isascii()]]
    plain, find = bpe._basic(P.PATTERN, bpe.ASCII), bpe.finder(P.PATTERN)
    assert len(plain.pattern) < 300 < len(bpe._basic(P.PATTERN).pattern)
    assert all(plain.findall(t) == find(t) == whole(t) for t in some)
    assert all(find(t) == whole(t) for _, t, _ in ODD if t)
    # a class without such characters can't be written for them
    assert bpe._basic(r"[^\p{Han}]+|\p{Han}", bpe.ASCII) is None
    assert bpe.finder(r"[^\p{Han}]+|\p{Han}")("a]b") == ["a]b"]


def base_spans(text):
    import re

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


SECRETS = [
    (1, "🙂 token: secret = abcdefghij password='hunter2hunter2' PassWd=short"),
    (2, "AKIA" + "A" * 12 + " then " + "b" * 20 + "B" * 20 + " at https://host.example/x " + "0123456789abcdef" * 2),
    (3, "q" * 20 + "R" * 20 + " with no key near"),
    (4, "AKIA" + "B" * 12 + "." * 500 + "c" * 20 + "D" * 20),
    (5, None),
    (6, ""),
    (6, "AKIAAKIA1234567890 token=token=abcdefgh"),
    (None, "api_key: 0123456789abcdef0123456789abcdef0"),
]


def test_secret_base_spans(spark, docs):
    both = spark.createDataFrame(SECRETS, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    found = Counter((r.id, tuple(sorted((s.start, s.kind, s.end) for s in [*r["assign"], *r.access, *r.hex]))) for r in secrets.scan(both).collect())
    assert found == Counter((i, tuple(base_spans(t))) for i, t in texts(both))


MIX = "aB3" + "x" * 37
LINKED = [
    (1, "AKIA" + "A" * 12 + " then " + MIX + " at https://host.example/x " + "0123456789abcdef" * 2),
    (2, MIX + " with nothing near"),
    (3, "AKIA" + "B" * 12 + "." * 500 + MIX),
    (4, MIX + "." * 199 + " https://a.example/b"),
    (5, "https://a.example/" + "/".join([MIX] * 3) + " AKIA" + "C" * 12),  # within the URL: no secret
    (5, "key/" + MIX + " http://ab.cd"),
    (6, "AKIA" + "D" * 12 + " https://only.endpoint and " + "b" * 20 + "B" * 20),  # no digit
    (7, None),
    (None, "🙂" + MIX + " " + MIX + "9 AKIA" + "E" * 12 + " https://u.v/w"),
    (None, "🙂" + MIX + " " + MIX + "9 AKIA" + "E" * 12 + " https://u.v/w"),
    (8, " ".join([MIX, "AKIA" + "F" * 12, "https://u.v/w", "x" * 90]) + " " + ("token=abcdefgh1 " + "y" * 30) * 3000),
]


def links_by_hand(text):
    import re

    ends = [m.span() for m in re.finditer(r"""https?://[^\x20\x09-\x0D"'<>]{4,}""", text)]
    runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/]{40,}", text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    runs = [(a, b) for a, b in runs if not any(a < d and b > c for c, d in ends)]
    parts = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [(a, 4, b) for a, b in ends]
    return sorted((a, b, *p) for a, b in runs for p in parts if a <= p[2] + 200 and b >= p[0] - 200)


def test_links_by_hand(spark):
    rows = spark.createDataFrame([(*r, "x") for r in LINKED], "doc_id long, text string, links string")
    found = secrets.scan(rows).collect()
    links = Counter((r.id, tuple((x.secret.start, x.secret.end, x.part.start, x.part.kind, x.part.end) for x in r.links or [])) for r in found)
    assert links == Counter((i, tuple(links_by_hand(t or ""))) for i, t in LINKED)
    assert sum(map(len, (r.linked for r in found))) > 8
    for r in found:
        assert {(s.start, s.kind) for s in r.linked} == {(x.secret.start, 3) for x in r.links or []} | {(x.part.start, 4) for x in r.links or [] if x.part.kind == 4}
    clean = {r.doc_id: r.text for r in secrets.redact(rows.where("doc_id in (1, 3)")).collect()}
    assert clean == {1: "[SECRET] then [SECRET] at [SECRET] [SECRET]", 3: "[SECRET]" + "." * 500 + MIX}


def test_secret_scan_agrees_with_sql(spark, tmp_path):
    import duckdb

    both = spark.createDataFrame(LINKED + SECRETS, "doc_id long, text string").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    both.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op2_secret_scan(spark, str(tmp_path))
    held = duckdb.connect()
    held.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = held.execute(queries.ORACLE["op2_secret_scan"])
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, found.select(*names).collect())) == Counter(want.fetchall())


def test_many_matches_in_one_text(spark):
    text = ("token=abcdefgh1 " + "🙂 " * 3) * 60_000
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("assign").alias("n"), F.element_at("assign", -1).alias("last")).first()
    assert row.n == 60_000 and (row.last.start, row.last.end) == (len(text) - 22, len(text) - 7)
    turns = spark.range(40_000).selectExpr("7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'some text' AS text")
    found = chat.format_conversations(turns).select(F.size("loss_spans").alias("n"), F.length(chat.under_mask(F.col("formatted"), F.slice("loss_spans", 19_990, 10))).alias("chars")).first()
    assert (found.n, found.chars) == (20_000, 90)


def test_redaction(spark):
    rows = spark.createDataFrame([(*r, "x") for r in SECRETS], "doc_id long, text string, found string")
    cleaned = {(r.doc_id, r.text) for r in secrets.redact(rows).collect()}
    assert (1, "🙂 token: secret = abcdefghij [SECRET]' PassWd=short") in cleaned
    assert (5, None) in cleaned and (6, "") in cleaned
    assert secrets.redact(rows).columns == rows.columns
    assert secrets.scan(rows.limit(0)).count() == 0


TURNS = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 0, "assistant", "a<\\|b<|"), (1, 1, "assistant", "|x"), (1, 2, None, None), (1, 3, "us\ner", "\n<\\\\|"), (2, None, "user", "first"), (2, 0, "user", "second"), (2, 0, "user", "second"), (None, 1, "user", "")]


def test_chat_reads_back(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    found = chat.format_conversations(rows).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = {}
    for c, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in found} == want
    assert {r.conv_id: r.loss for r in found} == {c: "".join(t for role, t in ts if role == "assistant") for c, ts in want.items()}
    for r in found:
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>")
    assert chat.format_conversations(rows.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<|\\im_endstart>a\n", max_size=30))
def test_escaping_is_reversible(text):
    import re

    hidden = re.sub(r"<(\\*)\|", r"<\\\1|", text)
    assert "<|" not in hidden
    assert re.sub(r"<\\(\\*)\|", r"<\1|", hidden) == text


def repeats_by_hand(rows, length=100):
    seen, out = set(), []
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    for row in order:
        t = row[1]
        covered = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                covered[p : p + length] = True
            seen.add(t[p : p + length])
        out.append((row[0], bytes(np.frombuffer(t, np.uint8)[~covered]), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum())))
    back = {(r[0], r[1]): o for r, o in zip(order, out, strict=True)}
    return Counter(back[r[0], r[1]] for r in rows)


REPEATS = [(1, "a" * 300), (2, "ab" * 200), (2, "ab" * 200), (None, "x" * 120 + "y"), (None, None), (3, ""), (3, "ab" * 60 + "z" * 150), (4, "q" + "x" * 130), (5, "é" * 90 + "ab" * 60), (6, "é" * 90)]


@pytest.mark.parametrize("hot", [1 << 15, 1])
def test_repeats_by_hand(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SEEN", min(hot, repeats.SEEN))
    monkeypatch.setattr(repeats, "BLOCK", 20_000)
    rows = spark.createDataFrame([(*r, 1) for r in REPEATS], "doc_id long, text string, key int")
    with_hash = [(r.doc_id, (r.text or "").encode(), r.h) for r in rows.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    found = repeats.remove(rows)
    assert set(found.columns) == {"doc_id", "key", "kept", "n_bytes", "n_removed", "n_spans"}
    assert Counter((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in found.collect()) == repeats_by_hand(with_hash)
    whole = [(r.doc_id, (r.text or "").encode(), 0) for r in docs.collect()]
    assert Counter((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in repeats.remove(docs).collect()) == repeats_by_hand(whole)
    assert repeats.remove(docs.limit(0)).count() == 0


def test_suffix_classes_against_strings():
    rng = np.random.default_rng(5)
    for _ in range(20):
        contexts = [bytes(rng.integers(97, 99, rng.integers(3, 60)).astype(np.uint8)) for _ in range(8)]
        places, group = repeats.suffix_classes(contexts, 7)
        joined = b"\0".join(contexts) + b"\0"
        of = {}
        for p, g in zip(places.tolist(), group.tolist(), strict=True):
            assert of.setdefault(joined[p : p + 7], g) == g
        assert len(set(of.values())) == len(of)


def test_likeness_is_of_paragraph_sets():
    def by_hand(a, b):
        x, y = Counter(iblt.paragraphs(a)), Counter(iblt.paragraphs(b))
        either = sum((x | y).values())
        return sum((x & y).values()) / either if either else 1.0

    rng = np.random.default_rng(2)
    pool = [f"Sentence {i}." for i in range(60)]
    a = [" ".join(rng.choice(pool, n)) for n in rng.integers(0, 400, 40)]
    b = [" ".join(rng.choice(pool, n)) for n in rng.integers(0, 400, 40)]
    assert iblt.likeness(iblt.digests(a), iblt.digests(b)).tolist() == pytest.approx([by_hand(x, y) for x, y in zip(a, b, strict=True)])


def by_multisets(a, b):
    x, y = Counter(iblt.paragraphs(a)), Counter(iblt.paragraphs(b))
    either = sum((x | y).values())
    return sum((x & y).values()) / either if either else 1.0


@pytest.mark.parametrize("part", [30_000, 1 << 30])
def test_each_document_meets_its_successor(spark, docs, monkeypatch, part):
    monkeypatch.setattr(iblt, "PART", part)
    rows = sorted(texts(docs), reverse=True)
    found = {r.doc_id: r for r in iblt.against_next(docs).collect()}
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        changed = iblt.edited(text, after)
        assert found[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (found[i].n_chars, found[i].near_edited, found[i].near_next) == (len(text), pytest.approx(by_multisets(text, changed)), pytest.approx(by_multisets(text, after)))
    assert len({r.fingerprint for r in found.values()}) == len({t for _, t in rows if t}) + any(not t for _, t in rows)


@pytest.mark.parametrize("part", [400, 1 << 30])
def test_successors_of_odd_rows(spark, docs, monkeypatch, part):
    """Null and repeated ids, and rows that are repeated very often: each follows a row of its id, or the first of the next."""
    monkeypatch.setattr(iblt, "PART", part)
    odd = [(1, "a"), (1, "b. c"), (None, None), (None, "z"), (-(1 << 63), "least"), (2, ""), *[(7, "hot row. again")] * 200, *[(None, f"n{i}") for i in range(60)], *[(7, f"same id {i}") for i in range(60)]]
    rows = spark.createDataFrame([(*r, "x", "y") for r in odd], "doc_id long, text string, h string, part string").repartition(7)
    hashed = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    chain = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.t, r.doc_id) for r in hashed), reverse=True)
    want = Counter((r[4], len(r[3]), hashlib.sha256(iblt.edited(r[3], n[3]).encode()).hexdigest()) for r, n in zip(chain, [*chain[1:], chain[0]], strict=True))
    found = iblt.against_next(rows.cache()).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    assert iblt.against_next(rows.limit(0)).count() == 0


def test_long_texts_without_stops_have_cells():
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(3000)]
    many = " ".join(rng.choice(words, 4000))
    for text in (many, "word " * 3000, "".join(map(chr, rng.integers(0x4E00, 0x9000, 6000))), "a" * 5000):
        assert "".join(iblt.paragraphs(text)).replace(" ", "") == text.replace(" ", "")
        half = text[: len(text) // 2] + "other " * 200
        assert iblt.likeness(iblt.digests([text]), iblt.digests([half]))[0] > 0.2
    assert iblt.likeness(iblt.digests(["x. " * 200_000 + "end"]), iblt.digests(["y. " * 200_000 + "end"]))[0] == pytest.approx(1 / 400_001)


def test_equal_texts_have_equal_fingerprints(spark):
    prints = [r.fingerprint for r in iblt.fingerprints(spark.createDataFrame([(1, "x. y"), (2, "x. y"), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert prints[0] == prints[1] != prints[2]


def print_by_hand(text):
    import xxhash

    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


@pytest.mark.parametrize("radius", [1, 2])
def test_simhash_components(spark, odd, docs, radius):
    both = odd.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text")).withColumn("fingerprint", F.lit("clash"))
    rows = [(i, print_by_hand(t)) for i, t in texts(both)]
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    found = simhash.components(both.drop("fingerprint"), radius=radius).collect()
    assert Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in found) == Counter((i, f, least.get(top(f))) for i, f in rows)


def test_one_of_each_group_stays(spark):
    rows = spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "other words here now"), (None, "x"), (4, None), (5, "")], "doc_id long, text string")
    assert Counter(r.doc_id for r in simhash.keep_first(rows).collect()) == Counter([1, 2, None, 4])
    assert simhash.keep_first(rows.limit(0)).count() == 0


def test_texts_of_one_id_are_judged_apart(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")

    def kept(rows):
        return Counter(map(tuple, simhash.keep_first(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")).select("doc_id", "text").collect()))

    assert kept([(5, a), (5, b), (3, c)]) == Counter([(5, a), (5, b), (3, c)])
    assert kept([(3, a), (5, b), (5, a)]) == Counter([(3, a), (5, b)])
    assert kept([(5, a), (5, a), (5, a + " end"), (None, b), (None, b), (None, c)]) in [Counter([(5, t), (None, b), (None, c)]) for t in (a, a + " end")]


def test_rows_without_id_are_deduplicated(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text), (None, text), (None, text + " end"), (None, "alone in the group"), (None, "alone in the group"), (None, None), (None, "")]
    found = simhash.keep_first(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, set_key string")).collect()
    assert Counter((r.doc_id, r.text or "", r.set_key) for r in found) == Counter([(7, text, "x"), (None, "alone in the group", "x"), (None, "", "x")])


def test_near_copies_go(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(120)]
        rows.append((3 * k, " ".join(words)))
        rows.append((3 * k + 1, " ".join([*words[:40], "Other", *words[41:]])))  # 111 of 121 shingles
        far = [w if i not in (10, 30, 50, 70, 90) else f"new{k}" for i, w in enumerate(words)]  # 91 of 141
        rows.append((3 * k + 2, " ".join(far)))
    rng.shuffle(rows)
    found = simhash.keep_first(spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [i for i in range(90) if i % 3 != 1]


def test_near_copies_meet_by_fingerprints(spark, docs, monkeypatch):
    """Without any band, fingerprints alone find the near copies within the radius."""
    rows = [(2 * i, t) for i, t in texts(docs)[:100]] + [(2 * i + 1, f"{t} end") for i, t in texts(docs)[:100]]
    sets = {}
    for i, t in rows:
        words = t.encode().lower().split()
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()

    def of(found):
        from xxhash import xxh64_intdigest

        bits = [sum(xxh64_intdigest(s, 42) >> b & 1 for s in found) * 2 > len(found) for b in range(64)]
        return sum(1 << b for b, one in enumerate(bits) if one)

    prints = {i: of(s) for i, s in sets.items()}
    made = simhash.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint % 2**64 for r in made} == prints
    near = {(i, i + 1) for i in sets if i % 2 == 0 and (prints[i] ^ prints[i + 1]).bit_count() <= 2 and 5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1])}
    assert len(near) > 5
    monkeypatch.setattr(simhash, "_bands", lambda sets, sizes: [np.empty(0, np.uint64)] * len(sets))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not kept & {b for _, b in near}


def test_fingerprints_of_long_sets(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (3, 0, 40, 7, 1, 100, 2)]
    sizes = np.array([len(s) for s in sets])
    whole = simhash._of_sets(sets, sizes)
    monkeypatch.setattr(simhash, "AT_ONCE", 16)
    assert (simhash._of_sets(sets, sizes) == whole).all()
    assert whole.tolist() == [int(simhash._of_counts(simhash._counts(s.tolist())[None], np.array([len(s)]))[0]) if len(s) else 0 for s in sets]


def test_near_copies_by_brute_force(spark, docs):
    def edited(text, at):
        words = text.split()
        return " ".join([*words[:at], "zz", *words[at + 1 :]])

    rows = texts(docs)
    rows += [(1000 + 10 * i + k, edited(t, 9 * k)) for i, t in rows[:60] for k in range(4)]  # copies of one text, near each other or not
    sets = {}
    for i, t in rows:
        words = t.encode().lower().split()
        sets.setdefault(frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset(), []).append(i)
    groups = [({s}, ids) for s, ids in sets.items()]
    for s in sets:
        near = [g for g in groups if s in g[0] or any(len(s & o) * 5 >= 4 * len(s | o) > 0 for o in g[0])]
        groups = [g for g in groups if g not in near] + [(set().union(*[g[0] for g in near]), sum([g[1] for g in near], []))]
    found = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == sorted(min(ids) for _, ids in groups)


def test_media_round_trip(spark, odd, docs):
    both = odd.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    found = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256, r.height) for r in media.columns(both).collect())
    want = Counter()
    for i, t in texts(both):
        payload = media.payload_of(t.encode())
        want[i, len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), hashlib.sha256(media.encode(payload)).hexdigest(), len(payload) // 576] += 1
    assert found == want
    assert media.columns(both.limit(0)).count() == 0


def test_a_damaged_medium_is_an_error():
    medium = bytearray(media.encode(media.payload_of(b"text")))
    assert media.decode(bytes(medium)).startswith(b"text")
    medium[50] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        media.decode(bytes(medium))


def test_shards_are_tar_files(spark, docs, tmp_path):
    import tarfile

    media.store(docs, f"file://{tmp_path}/shards").collect()
    names = [m.name for p in (tmp_path / "shards").iterdir() for m in tarfile.open(p).getmembers()]
    assert sorted(set(names)) == sorted({hashlib.sha256(media.payload_of(t.encode())).hexdigest() + ".png" for _, t in texts(docs)})


def packed(frame):
    rows = sorted(frame.collect(), key=lambda r: (r.sequence_id, r.offset))
    filled = Counter()
    for r in rows:
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    return rows, filled


SPECIAL = ["a <|endoftext|> b", "x<|endoftext|>y.", "<|startoftext|>", "<|ENDOFTEXT|> <|endof\ntext|> <| endoftext|>", "|<|endoftext|>|. <|startoftext|>q | <|endoftext|><|endoftext|>", "e<|endoftext|>\u0301 don't"]


def test_words_are_forgotten_without_effect(docs):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), [t for _, t in texts(docs)] + SPECIAL
    packing._encoder.cache_clear()
    for begin in range(0, len(own), 20):
        part = own[begin : begin + 20]
        assert packing.encode(part, WORDS, 1, remembered=50) == [np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in part]
    packing._encoder.cache_clear()


def test_packing(spark, odd, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    special = spark.createDataFrame([(20 + i, t) for i, t in enumerate(SPECIAL)], "doc_id long, text string")
    both = odd.where("doc_id is null or doc_id < 5 or doc_id = 6").select("doc_id", "text").unionByName(special).unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), "text")).withColumn("offset", F.lit("clash"))
    rows, filled = packed(packing.pack(both, WORDS))
    assert all(n <= 2048 for n in filled.values())
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in filled.values()) <= 0.001 * sum(filled.values())
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, t in texts(both):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc, total in sorted(pieces[i]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at : at + length].tobytes()))
            at += length
        assert at == len(ids)
    assert packing.pack(both.limit(0), WORDS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(1, 60))
def test_fill_is_closest(counts, room):
    items = [n for n, c in counts.items() for _ in range(c)]
    sums = {0}
    for n in items:
        sums |= {s + n for s in sums}
    taken = packing.fill(counts, room)
    assert not Counter(taken) - Counter(items)
    assert sum(taken) == max(s for s in sums if s <= room)
