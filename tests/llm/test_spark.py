"""The operators on DataFrames: brute force, held-out accuracy, and rows that are unlike others."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.oracle import connection, difference
from weirlake.llm import bpe, chat, decontam, ngram_join, pii, quality_model, quality_rules, secrets, toxicity, warc
from weirlake.llm import queries as Q
from weirlake.llm.common import table

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PATH = Q.tokenizer_path()
LONG = "word " * 60_000
#: Nulls in any column, empty and very long texts, repeated rows, control characters.
ODD = [
    (1, None, "en", "s", 0), (2, "", None, None, None), (None, "text without id", "en", "s", 5), (3, LONG, "en", "s", 1), (4, "same text here", "en", "s", 3), (4, "same text here", "en", "s", 3),
    (5, "same text here", None, "s", 3), (6, " \n\t ", "en", None, 2), (7, "é😀\x00<|endoftext|> a@b.co", "xx", "s", 9), (8, "A" * 50_000, "en", "s", 1),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """The odd rows with further columns whose names are used inside."""
    df = spark.createDataFrame(ODD, DDL)
    return df.withColumns({c: F.lit(1) for c in ("score", "group", "_email", "cid", "spans", "term", "_key", "kept", "a.b", "_row", "_t1", "t1", "s1", "c0")})


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DDL)


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def items_of(spark):
    return spark.createDataFrame([(1, "same text here"), (2, None), (None, ""), (3, "same text here")], "item_id long, text string")


BY_ROW = {
    "pii": lambda s, d: pii.scan(d),
    "bpe": lambda s, d: bpe.round_trip(d, PATH),
    "rules": lambda s, d: quality_rules.judge(d),
    "model": lambda s, d: quality_model.classify(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels_of(s))),
    "secrets": lambda s, d: secrets.scan(d),
    "join": lambda s, d: ngram_join.join(d, 4, 85),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_odd_rows_and_empty_tables(spark, odd, none, name):
    rows = BY_ROW[name](spark, odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert len({tuple(r) for r in rows if r["doc_id"] == 4}) == 1
    empty = BY_ROW[name](spark, none)
    assert empty.count() == 0 and empty.columns == BY_ROW[name](spark, odd).columns


def test_other_operators_on_odd_rows(spark, odd, none):
    found = decontam.find(odd, items_of(spark))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, i) for d in (4, 5) for i in (1, 3)}
    assert decontam.find(none, items_of(spark)).count() == 0 == decontam.find(odd, items_of(spark).limit(0)).count()
    kept = ngram_join.deduplicate(odd, 4, 85)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8] and kept.columns == odd.columns
    clean = {r.doc_id: r for r in pii.sanitise(odd).collect()}
    assert clean[1].text is None and clean[2].text == "" and clean[7].text == "é😀\x00<|endoftext|> [EMAIL]" and clean[7].n_chars == len(clean[7].text)
    assert quality_model.keep(odd).columns == odd.columns and quality_model.keep(none).count() == 0


@pytest.mark.parametrize("name", ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii_sanitisation", "bpe_encoding_and_decoding"])
def test_stages_on_odd_rows_and_empty_tables(spark, odd, none, tmp_path, name):
    import corpus_pipeline as P

    items_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(P.STAGES)[name]
    passage = spark.createDataFrame([(None, "has same text here in it", "en", "s", 1), (9, "same text", "en", "s", 1), (9, "same text here", "en", "s", 1)], DDL)
    docs = odd.unionByName(passage, allowMissingColumns=True)
    out = stage(spark, docs, str(tmp_path))
    rows, own = out.collect(), [tuple(r) for r in docs.collect()]
    if name == "bpe_encoding_and_decoding":
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in own)
    else:
        assert out.columns == docs.columns
    if name in ("quality_classifier", "benchmark_decontamination", "ngram_jaccard_join"):
        assert not Counter(map(tuple, rows)) - Counter(own)  # rows as they were
    if name == "benchmark_decontamination":
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in own if "same text here" not in (r[1] or ""))
    if name == "ngram_jaccard_join":
        assert sum(r.text == "same text here" for r in rows) == 1 and {(9, "same text"), (None, "text without id")} <= {(r.doc_id, r.text) for r in rows}
    if name == "pii_sanitisation":
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in own) and not any("@" in (r.text or "") for r in rows)
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_encoded_texts_decode(spark, odd):
    back = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in ODD)


def test_oracles(spark):
    con = connection(SMALL)
    assert [d for n, sql in Q.ORACLE.items() if (d := difference(spark, n, Q.QUERIES[n], sql, SMALL, con))] == []


def luhn(number):
    return sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(number))) % 10 == 0


def base_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    cards = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out += [("card", *m.span()) for m, d in cards if 13 <= len(d) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


PII_TEXTS = [
    "a@b.co", "x..a@b.c@d.e.f_g@h.i, a@b.com_x@y.com", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.1 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111-22 4111111111111111", "+1 (386) 555-3733 +1((( +12345678 +1234567890123456",
    "é" * 50 + "😀 q@w.er 😀 1.1.1.1", "a" * 20000 + "@" + "b" * 20000 + ".c", "1" * 30000, "1 " * 30000, "+1" + "(" * 30000, "a@b.c " * 500, "5@1.2.3.4 +1.2.3.4-5678901",
]


def test_personal_data_equals_brute_force(spark):
    own = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    rows = [(i, t) for i, t in enumerate(PII_TEXTS)] + [(1000 + r.doc_id, r.text) for r in own]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base = base_pii(text)
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text[:80]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in base) for k in pii.KINDS]
        assert got[i].spans.startswith(want)


def test_terms_that_give_away_an_entity(spark):
    other = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}or" for i in range(300)]
    near = lambda i, k: " ".join(other[(7 * i + k * j) % 300] for j in range(1, 11))
    docs = [(i, near(i, 3) + " " + near(i, 5)) for i in range(400)] + [(1000 + i, f"{near(i, 11)} Zorblatt zor@mail.com {near(i, 13)}") for i in range(6)] + [(2000, "here zorblatt again")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r.term for r in pii.disclosing_terms(df).collect()] == ["zorblatt"]
    assert [r.doc_id for r in pii.scan(df).where("n_term > 0").orderBy("doc_id").collect()] == [*range(1000, 1006), 2000]
    assert {r.doc_id: r.text for r in pii.sanitise(df).where("doc_id = 2000").collect()} in ({2000: "here  again"}, {2000: "here [WORD] again"})
    copies = df.where("doc_id = 1000").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9)))).drop("k")
    assert pii.disclosing_terms(df.where("doc_id < 1000").unionByName(copies)).count() == 0


def test_copies_are_no_evidence_against_a_term(spark):
    docs = [(i, f"plain number{chr(97 + i % 26)}{chr(97 + i // 26)}x text") for i in range(600)]
    docs += [(1000 + i, f"letter{chr(97 + i)}q Zorblatt zor@mail.com again{chr(97 + i)}q") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    copied = df.unionByName(df.where("doc_id = 1000").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(1000)))).drop("k"))
    found = [{(r.term, round(r.share, 9)) for r in pii.disclosing_terms(x).collect()} for x in (df, copied)]
    assert found[0] == found[1] and [t for t, _ in found[0]] == ["zorblatt"]


def terms_by_force(texts, width, support, least):
    """Terms with their share, counted over distinct texts one after another."""
    import math

    import regex

    words = lambda t: set(regex.findall(r"\p{L}[\p{L}\p{N}_]{2,}", t.lower()))
    texts = {t or "" for t in texts}
    by_entity, by_pair = {}, {}
    for t in texts:
        for kind, a, b in base_pii(t):
            value = f"{kind}:{t[a:b].lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', t[a:b])}"
            before = t[:a] if a <= width else regex.sub(r"^[\p{L}\p{N}_]+", "", t[a - width : a])
            near = before + " \n " + regex.sub(r"[\p{L}\p{N}_]+$", "", t[b : b + width])
            by_entity.setdefault(value, set()).add((near, t))
            for w in words(near):
                by_pair.setdefault((value, w), set()).add((near, t))
    enough = lambda found: min(len({c for c, _ in found}), len({t for _, t in found})) >= support
    n_of = lambda found: len({t for _, t in found})
    n_term = Counter(w for t in texts for w in words(t))
    out = {}
    for (value, w), found in by_pair.items():
        if enough(found) and enough(by_entity[value]) and n_term[w]:
            rare = len(texts) / n_of(by_entity[value])
            share = math.log2(min(1, n_of(found) / n_term[w]) * rare) / math.log2(rare) if rare > 1 else 0
            if share >= least:
                out[w] = max(out.get(w, 0), share)
    return out


def test_terms_equal_brute_force(spark):
    own = [r.text for r in table(spark, SMALL, "documents").select("text").collect()]
    made = []
    for e in range(12):  # entities in so many texts, each with terms of its own that also stand elsewhere
        for i in range(e + 1):
            made.append(f"the note {'abcdefghijkl'[i]}{e}x name{'abcdefghijkl'[e]}q wrote u{e}@mail.com and again u{e}@mail.com about tale{'abcdefghijkl'[e % 3]}z " + f"the end w{i}v " * 3)
    made += [f"name{'abcdefghijkl'[e]}q elsewhere {i}" for e in range(12) for i in range(e % 4)]
    texts = [*own, *made, *made[:20] * 3, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for width, support, least in ((120, 3, 0.8), (40, 2, 0.6), (120, 1, 0.9)):
        want = terms_by_force(texts, width, support, least - 1e-9)
        got = {r.term: r.share for r in pii.disclosing_terms(df, width, support, least).collect()}
        assert {k for k, v in want.items() if v > least + 1e-9} <= set(got) <= set(want) and got
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_a_term_is_judged_by_texts_and_not_by_mentions_or_copies(spark):
    """One text with an address three times is one piece of evidence; copies hide nothing."""
    plain = [(i, f"plain number{chr(97 + i % 26)}{chr(97 + i // 26)}x text") for i in range(200)]
    thrice = [(1000, " ".join(f"part{chr(97 + k)}q mumble own@mail.com part{chr(97 + k)}r." + " filler" * 40 for k in range(3)))]
    six = [(2000 + i, f"letter{chr(97 + i)}q zorblatt zor@mail.com again{chr(97 + i)}q") for i in range(6)]
    other = [(3000 + i, "zorblatt without it") for i in range(40)]
    found = {r.term for r in pii.disclosing_terms(spark.createDataFrame(plain + thrice + six + other, "doc_id long, text string")).collect()}
    assert found == {"zorblatt"}


def components_by_force(texts, n, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    order = sorted(sets)
    for i in order:
        for j in order:
            if j < i and sets[i] and root[i] != root[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_join_equals_brute_force(spark, monkeypatch):
    """With shingles hot from two documents on, so that both ways of dealing them are taken."""
    monkeypatch.setattr(ngram_join, "HOT", 2)
    docs = table(spark, SMALL, "documents")
    want = components_by_force([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, 4, 85).collect()}
    assert got == want


def test_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Small leaves, so that regions are split into cells and blocks."""
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(70):
        own = list(base)
        for k in range(i % 7):
            own[(17 * i + 29 * k) % 120] = f"e{i}x{k}"
        texts.append((i, " ".join(own)))
    far = [(100 + i, " ".join([*(f"q{i}y{k}" for k in range(60)), *base[:60]])) for i in range(20)]
    want = components_by_force(texts + far, 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(texts + far, "doc_id long, text string"), 4, 85).collect()}
    assert got == want


def test_regions_of_several_balls_are_joined(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    # Chains of versions, of which each is linked to the next alone: every link counts.
    sets = [[1000 * chain + 4 * version + x for x in range(50)] for chain in range(4) for version in range(60)]
    rows = [(1, cid, len(s), cid, cid, cid, s) for cid, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "region long, cid long, n long, s1 long, s2 long, own long, set array<long>")
    found = ngram_join.links(df.drop("set"), df.select("s1", "s2", "own", "set"), 85)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found.collect():
        assert len(set(sets[r.a]) & set(sets[r.b])) * 100 >= 85 * len(set(sets[r.a]) | set(sets[r.b]))
        root[find(r.a)] = find(r.b)
    assert len({find(i) for i in range(len(sets))}) == 4


def test_only_one_ball_is_connected_already(spark):
    rows = [(1, 10, 3, 7), (1, 11, 3, 8), (2, 12, 3, 7), (2, 13, 3, 7), (3, 14, 3, None), (3, 15, 3, 7)]
    df = spark.createDataFrame([(*r, r[1], r[1], r[1]) for r in rows], "region long, cid long, n long, ball long, s1 long, s2 long, own long")
    sized = ngram_join._with_size(df)
    assert {r.region for r in sized.collect()} == {1, 3}
    # Blocks keep the key by which the sets are found.
    assert {(r.cid, r.own) for r in ngram_join._in_blocks(sized).collect()} == {(c, c) for c in (10, 11, 14, 15)}


def test_blocks_of_one_ball_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    rows = [(1, c, 3, 7 if c < 100 else 8 if c < 140 else 9 if c == 140 else None) for c in range(150)]
    df = spark.createDataFrame([(*r, r[1], r[1], r[1]) for r in rows], "region long, cid long, n long, ball long, s1 long, s2 long, own long")
    by = {}
    for r in ngram_join._in_blocks(df).collect():
        by.setdefault(r.region, set()).add(r.cid)
    meet = {(a, b) for own in by.values() for a in own for b in own if a < b}
    ball = {r[1]: r[3] for r in rows}
    assert {(a, b) for a in ball for b in ball if a < b and (ball[a] is None or ball[b] is None or ball[a] != ball[b])} <= meet
    # Of the largest ball's 25 blocks no two were brought together.
    assert sum(1 for a, b in meet if ball[a] == ball[b] == 7) < 100 * 99 / 2 / 10


def test_rows_of_one_component(spark):
    """One row stays of each component, whatever ids the rows have."""
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "x")
    rows = [(2, near, 1), (1, text, 2), (1, text, 3), (None, text, 4), (None, text, 5), (3, "other words of its own here", 6), (3, near, 7), (5, "", 8), (5, "", 9), (None, "alone by itself in this table", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long").withColumn("t1", F.lit(0)).withColumn("cid", F.lit(0))
    out = ngram_join.deduplicate(df, 4, 85)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "alone by itself in this table"), (1, text), (3, "other words of its own here"), (5, ""), (5, "")]


def test_archives(spark, tmp_path):
    pages = [(3, "http://b.example/x", "same"), (1, "https://a.example/", "same"), (2, None, None), (4, "http://www.a.example:80/y?q#z", "é\r\n\r\nWARC/1.1\r\n"), (5, "u", ""), (4, "http://a.example/y", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("date", F.lit(1))
    index = warc.archive(df, str(tmp_path / "w"))
    rows = index.collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_digest, r.payload_bytes) for r in rows) == Counter((p, digest(h), len((h or "").encode())) for p, _, h in pages)
    assert {r.page_id: r.refers_to for r in rows if r.record_type == "revisit"} == {3: 1, 5: 2}
    assert sorted((r.urlkey, r.date, r.page_id or 0) for r in rows) == [(r.urlkey, r.date, r.page_id or 0) for r in rows]
    assert all(r.record_type == "response" for r in warc.archive(df, str(tmp_path / "v"), min_payload=100).collect())
    assert warc.archive(df.limit(0), str(tmp_path / "e")).count() == 0


def test_records_by_place_and_merges_of_many_ranges(spark, tmp_path):
    """Each record is read by file, place and length alone; files are cut by bytes; ranges hold few rows each."""
    big = "<p>" + "".join(chr(97 + i * i % 26) for i in range(60_000)) * 300  # over 16 MB
    pages = [(i, f"http://h{i % 7}.example/p{i % 50}", f"body {i % 300} " * 20) for i in range(1000)] + [(5000, "http://big.example/", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    index = warc.archive(df, str(tmp_path / "w"), file_bytes=8000)
    rows = index.collect()
    assert len({r.archive for r in rows}) > 10 and Counter(r.page_id for r in rows) == Counter(p[0] for p in pages)
    html = {p[0]: p[2] for p in pages}
    for r in [*rows[::97], next(r for r in rows if r.page_id == 5000)]:
        with open(tmp_path / "w" / r.archive, "rb") as f:
            f.seek(r.offset)
            head, block = warc.read_record(f.read(r.length))
        assert head["warc-record-id"] == f"<urn:page:{r.page_id}>" and block.endswith(b"\r\n\r\n" + (html[r.page_id].encode() if r.record_type == "response" else b""))
    merged = warc.merge_index(spark.createDataFrame(rows[::-1], index.schema), rows_a_range=50)
    parts = merged.rdd.glom().map(lambda p: [(r.urlkey, r.date, r.page_id) for r in p]).collect()
    assert sum(map(bool, parts)) > 10 and [x for p in parts for x in p] == sorted((r.urlkey, r.date, r.page_id) for r in rows)
    assert max(map(len, parts)) < 200


def test_conversations(spark):
    rows = [(1, 0, "user", "</s>[INST] hi"), (1, 1, "assistant", "yo <|im_end|>\n"), (1, 1, "assistant", "yo <|im_end|>\n"), (2, None, None, None), (None, 3, "assistant", "é😀"), (None, 3, "assistant", "é😀"), (3, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "a.b": F.lit(2)})
    own = chat.digests(chat.format_conversations(df, PATH)).collect()
    out = {r.conv_id: r for r in own}
    assert len(own) == 5  # rows without conv_id are conversations of their own
    assert {k: (r.n_turns, r.loss_chars) for k, r in out.items()} == {1: (3, 28), 2: (1, 0), None: (1, 2), 3: (1, len(LONG))}
    assert out[1].loss_sha256 == hashlib.sha256(b"yo <|im_end|>\n" * 2).hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH).count() == 0


def held_out_auc(rows):
    rows = sorted(rows)
    pos = sum(y for _, y in rows)
    rank = sum(i for i, (_, y) in enumerate(rows, 1) if y)
    return (rank - pos * (pos + 1) / 2) / (pos * (len(rows) - pos))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").limit(4000), table(spark, sf, "labels")
    out = toxicity.score(docs, toxicity.train(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert held_out_auc([(r.score, r.toxic) for r in out]) > 0.97
    assert sum(r.predicted == r.toxic for r in out) / len(out) > 0.95
    moved = docs.limit(50).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    model = toxicity.train(docs, labels)
    a, b = (sorted(r.score for r in toxicity.score(d, model).collect()) for d in (docs.limit(50), moved))
    assert a == b


def test_quality_model_keeps_good_texts(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    out = quality_model.classify(docs).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.35


def test_rules_keep_good_texts_and_find_outliers(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    out = quality_rules.judge(docs).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.35


def plain_texts(n, first=0):
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(5))
    return [". ".join(word(7919 * (first + i) + 613 * j) for j in range(40)) for i in range(n)]


RULES_DDL = "doc_id long, text string, lang string, source string"


def test_rules_by_group_size(spark):
    shouting = [t.upper().replace(".", "") for t in plain_texts(60, 5000)]
    rows = [(i, t, "en", "s") for i, t in enumerate(plain_texts(400))] + [(1000 + i, t, "en", "loud") for i, t in enumerate(shouting)]
    out = quality_rules.judge(spark.createDataFrame(rows, RULES_DDL)).collect()
    assert all(r.kept for r in out)  # a small group of its own kind
    one = [*rows[:400], (1000, shouting[0], "en", "s")]
    assert [r.doc_id for r in quality_rules.judge(spark.createDataFrame(one, RULES_DDL)).where("not kept").collect()] == [1000]
    few = [*rows[:12], (1000, shouting[0], "en", "s")]
    assert all(r.kept for r in quality_rules.judge(spark.createDataFrame(few, RULES_DDL)).collect())  # too few rows to know what is usual


def test_least_determinant_equals_brute_force():
    from itertools import combinations

    import numpy as np

    for seed, n in ((1, 10), (2, 11), (3, 12)):
        rng = np.random.default_rng(seed)
        x = rng.normal(0, 0.3, (n, len(quality_rules.XS)))
        x[: n // 5] += 2  # a cluster of outliers
        det = lambda rows: np.linalg.slogdet(np.cov(x[list(rows)], rowvar=False, bias=True) * quality_rules.CONSISTENCY + np.diag(quality_rules.FLOORS**2))[1]
        least = min(det(r) for r in combinations(range(n), quality_rules.half(n)))
        assert abs(quality_rules.starts(x)[0][0] - least) < 1e-9


def test_a_fifth_of_clustered_outliers_is_rejected(spark):
    """In a large group of its own (more rows than a start's sample), with vectors made for it."""
    import numpy as np

    rng = np.random.default_rng(5)
    for share in (0.05, 0.15, 0.2, 0.24):
        n = 3000
        x = rng.normal(0, 0.1, (n, len(quality_rules.XS))) + 0.5
        bad = int(n * share)
        x[:bad] = rng.normal(0, 0.01, (bad, len(quality_rules.XS))) + np.array([0.5, 0.5, 0.5, 0.5, 1.6, 1.2, 0.5])
        rows = [(i, "g", "en", *map(float, v)) for i, v in enumerate(x)]
        good = spark.createDataFrame(rows, "row long, group string, of string, " + ", ".join(f"{c} double" for c in quality_rules.XS))
        table = quality_rules._mixed(quality_rules.determinant_estimates(good))
        out = quality_rules._distance(good, table).select("row", "d2").collect()
        wrong = [r.row for r in out if (r.d2 > quality_rules.CUTOFF) != (r.row < bad)]
        assert len(wrong) < n / 500, (share, len(wrong))


def test_pipeline_stages_equal_brute_force(spark):
    import corpus_pipeline as P

    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii_sanitisation", "bpe_encoding_and_decoding"]
    one = P.quality_classifier(spark, docs, SMALL)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in quality_model.classify(docs).where("kept").collect()}
    assert {r.doc_id for r in one.collect()} == kept
    own = [(r.doc_id, r.text) for r in one.collect()]
    two = P.ngram_jaccard_join(spark, one, SMALL)
    want = {i for i, (n, c) in components_by_force(own, 5, 80).items() if i == c}
    assert {r.doc_id for r in two.collect()} == want
    three = P.benchmark_decontamination(spark, two, SMALL)
    items = [decontam.normalise(r.text).strip() for r in table(spark, SMALL, "benchmark").collect()]
    exact = {i for i, t in own if i in want and any(x in decontam.normalise(t) for x in items)}
    left = {r.doc_id for r in three.collect()}
    assert exact and left == want - exact
    four = {r.doc_id: r for r in P.pii_sanitisation(spark, three, SMALL).collect()}
    assert set(four) == left and not any(base_pii(r.text) for r in four.values())
    assert all(four[i].text == t for i, t in own if i in left and not base_pii(t))
    texts = spark.createDataFrame([(r.doc_id, r.text) for r in four.values()], "doc_id long, text string")
    codec = bpe.Codec(PATH)
    for r in P.bpe_encoding_and_decoding(spark, texts, SMALL).collect():
        ids = codec.encode([four[r.doc_id].text])[0]
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest()) and r.decoded_sha256 == hashlib.sha256(four[r.doc_id].text.encode()).hexdigest()
    assert P.ORACLE_SQL is None


def test_deduplication_shuffles_no_text_that_must_stay(spark):
    """Whole rows that no table row can ask for are read and written, also where no table may be broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    data = [(i, text(i)) for i in range(40)] + [(100 + i, text(i)) for i in range(5)] + [(7, text(7)), (None, None), (201, None), (201, None), (202, "")]
    try:
        spark.conf.set(key, "-1")
        for rows in (data, list(dict.fromkeys(data))):
            out = ngram_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80)
            plan = out._jdf.queryExecution().executedPlan().toString()
            first = plan.split("Union", 1)[1].split("ArrowEvalPython", 1)[0]
            assert "Exchange" not in first and "Join" not in first
            got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect())
            stay = sorted([(i, text(i)) for i in range(40)] + [(-1, ""), (201, ""), (202, "")] + [(201, "")] * (rows is data))
            assert got == stay
    finally:
        spark.conf.set(key, was)
