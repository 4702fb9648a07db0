"""Spans, token ids, mixes and reading levels."""

import base64
import quopri

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricloom.llm import p2_spans as P2
from metricloom.llm import p6_tokens as P6
from metricloom.llm import p7_mix as P7
from metricloom.llm import p8_reading as P8
from metricloom.llm.mail import own_text

# -- spans


def shared(texts, length):
    runs = {}
    for i, t in texts.items():
        for p in range(len(t) - length + 1):
            runs.setdefault(t[p : p + length], set()).add(i)
    out = []
    for i, t in sorted(texts.items()):
        hit = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            if len(runs[t[p : p + length]]) > 1:
                hit[p : p + length] = 1
        edge = np.flatnonzero(np.diff(np.r_[0, hit]))
        out += [(i, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


@pytest.mark.parametrize("length,anchor", [(6, None), (6, 6), (6, 1), (1, None), (9, 4)])
def test_spans_against_brute_force(spark, length, anchor):
    rng = np.random.default_rng(length)
    texts = {i: "".join(rng.choice(list("ACé😀"), rng.integers(0, 60))) for i in range(25)}
    texts |= {30: "A" * 50, 31: "A" * 20 + "C", 32: "", 33: texts[1], 34: "ACGT" * 10, 35: "x" + "ACGT" * 10}
    df = spark.createDataFrame([*texts.items(), (1, texts[1]), (90, None), (None, texts[2])], "seq_id int, seq string").withColumn("rid", F.lit(5)).withColumn("pos", F.lit("x"))
    got = P2.shared_spans(df.repartition(3), "seq_id", "seq", length, anchor)
    assert sorted((r["rid"], r["span_start"], r["span_end"]) for r in got.collect()) == shared(texts, length)


@pytest.mark.parametrize("block", [7, 16, 200])
def test_spans_over_pieces_of_long_texts(spark, monkeypatch, block):
    monkeypatch.setattr(P2, "BLOCK", block)
    rng = np.random.default_rng(block)
    texts = {i: "".join(rng.choice(list("AC"), rng.integers(0, 90))) for i in range(12)}
    df = spark.createDataFrame([*texts.items()], "seq_id int, seq string")
    got = P2.shared_spans(df.repartition(2), "seq_id", "seq", 8)
    assert sorted((r["rid"], r["span_start"], r["span_end"]) for r in got.collect()) == shared(texts, 8)


def test_hot_span_and_long_text(spark):
    long = "".join(np.random.default_rng(0).choice(list("ACGT"), 5000))
    rows = [(i, "ACGTTGCA" * 10 + chr(0x4E00 + i)) for i in range(300)] + [(1000, long), (1001, "N" + long[1000:4000])]
    df = spark.createDataFrame(rows, "seq_id int, seq string")
    got = {(r["rid"], r["span_start"], r["span_end"]) for r in P2.shared_spans(df, "seq_id", "seq", 64).collect()}
    assert got == {(i, 0, 80) for i in range(300)} | {(1000, 1000, 4000), (1001, 1, 3001)}
    left = {r["rid"]: (r["txt"], r["n_removed"]) for r in P2.cleaned(df, "seq_id", "seq", 64).collect()}
    assert left[0] == (rows[0][1], 0) and left[1] == (chr(0x4E01), 80) and left[1000] == (long, 0) and left[1001] == ("N", 3000)


def test_cleaned_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P2, "MOST_BITS", 7)  # a map that lets through nearly all
    rng = np.random.default_rng(3)
    texts = {i: "".join(rng.choice(list("AC"), rng.integers(0, 40))) for i in range(20)}
    df = spark.createDataFrame([*texts.items(), (4, texts[4]), (50, None)], "seq_id int, seq string").repartition(3)
    runs = {}
    for i, t in sorted(texts.items()):
        for p in range(len(t) - 5):
            runs.setdefault(t[p : p + 6], i)
    want = {50: (None, None)}
    for i, t in texts.items():
        gone = {q for p in range(len(t) - 5) if runs[t[p : p + 6]] < i for q in range(p, p + 6)}
        want[i] = ("".join(c for q, c in enumerate(t) if q not in gone), len(gone))
    assert {r["rid"]: (r["txt"], r["n_removed"]) for r in P2.cleaned(df, "seq_id", "seq", 6).collect()} == want
    assert {r["rid"]: r["n_later"] for r in P2.shared_shares(df, "seq_id", "seq", 6).collect()} == {i: n for i, (_, n) in want.items()}


def test_shares(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, "xxabcdef"), (3, ""), (4, None)], "i int, t string")
    got = {r["rid"]: (r["n_symbols"], r["n_shared"], r["share"], r["n_later"]) for r in P2.shared_shares(df, "i", "t", 4).collect()}
    assert got == {1: (8, 6, 0.75, 0), 2: (8, 6, 0.75, 6), 3: (0, 0, None, 0), 4: (None, None, None, None)}
    assert P2.shared_spans(df.limit(0), "i", "t").count() == 0


@given(st.text(alphabet="AB", min_size=0, max_size=80), st.integers(1, 20))
def test_run_hashes_tell_runs_apart(t, length):
    h = P2.run_hashes(P2._codes(t), length, P2._SEEDS[0])
    runs = [t[i : i + length] for i in range(len(t) - length + 1)]
    assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs))


# -- tokens


@pytest.fixture(scope="module")
def coder():
    with open(P6.VOCABULARY, "rb") as f:
        return P6.Encoder(f.read())


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def encoded(coder, texts):
    ids, offsets, _ = coder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


ODD = ["", " ", "  ", "\n", " \n x", "a  b", "I'll we've 'S 's ''s x'", "it's'll", "日本語 テキスト", "1²½Ⅳ", "<|endoftext|> <s>", " a b", "é" * 300, "a" * 3000, " " * 500 + "x", "👩‍🔬🧪", "\x00\x01", "a\r\n\r\nb\t\tc", "xyz!?" * 400, "'", " '", "don't 'tis 'ritz 'l"]


def test_ids_of_odd_texts(coder, reference):
    assert encoded(coder, ODD) == [e.ids for e in reference.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("  \n\t'sStrevmldab1!é日")), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=5))
def test_ids_of_any_text(coder, reference, texts):
    assert encoded(coder, texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_ids_and_counts_of_a_table(spark, coder, reference):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "abc"), (5, "again")]
    df = spark.createDataFrame(rows, "key int, text string").withColumn("ids", F.lit("x")).withColumn("id", F.lit(3))
    got = sorted(((r["id"] is None, r["id"] or 0), list(r["ids"])) for r in P6.token_ids(df, "key", "text").collect())
    want = sorted(((k is None, k or 0), reference.encode(t, add_special_tokens=False).ids if t else []) for k, t in rows)
    assert got == want
    assert sorted(r["n_tokens"] for r in P6.token_counts(df, ["key"], "text").collect()) == sorted(len(w) for _, w in want)
    back = P6.decode_ids(P6.token_ids(df.where("key is not null"), "key", "text"), "id", "ids")
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for k, t in rows if k is not None)
    assert P6.token_ids(df.limit(0), "key", "text").count() == 0
    texts, word = {k: t or "" for k, t in rows if k != 5}, {v: k for k, v in coder.ranks.items()}
    for r in P6.token_offsets(df.where("key is null or key <> 5"), "key", "text").collect():
        raw = texts[r["id"]].encode()
        assert r["n_bytes"] == len(raw)
        assert [raw[a : a + len(word[i])] for a, i in zip(r["starts"], r["ids"], strict=True)] == [word[i] for i in r["ids"]]
        assert sum(len(word[i]) for i in r["ids"]) == len(raw)
    assert P6.token_offsets(df.limit(0), "key", "text").count() == 0


def test_blocks_and_cache(coder, monkeypatch):
    want = encoded(coder, ODD)
    monkeypatch.setattr(P6, "CACHE", 0)
    assert [x for b in P6.blocks(ODD, 50) for x in encoded(coder, b)] == want


def test_colliding_hashes_fall_back(coder, monkeypatch):
    want = encoded(coder, ODD)
    monkeypatch.setattr(coder, "value", np.ones_like(coder.value))
    assert encoded(coder, ODD) == want


# -- mixes


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 200), st.dictionaries(st.integers(1, 40), st.integers(0, 5), max_size=6), st.sampled_from([20, 1000]))
def test_fitted_counts(rest, lengths, budget):
    got = P7.fit_counts(rest, lengths, budget)
    used = sum(n * c for n, c in got.items())
    assert used <= rest and all(0 < c <= lengths[n] for n, c in got.items())
    if budget >= rest:
        sums = {0}
        for n, c in lengths.items():
            sums = {s + n * i for s in sums for i in range(c + 1) if s + n * i <= rest}
        assert used == max(sums)


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, s, int(n)) for i, (s, n) in enumerate([("big", n) for n in rng.integers(1, 50, 400)] + [("same", 7)] * 300 + [("small", n) for n in rng.integers(1, 9, 20)] + [(None, 30)] * 5 + [("big", 0)] * 3)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    total = sum(n for *_, n in rows)
    have = {s: sum(n for _, t, n in rows if t == s) for s in ("big", "same", "small")}
    wish = [(1, "big", 0.5, 1, 0.3), (1, "same", 0.45, 1, 0.3), (1, "small", 0.05, 4, 0.3), (2, "small", 0.9, 3, 2.0), (2, "gone", 0.1, 9, 2.0), (3, "big", 1.0, 3, 1.5)]
    targets = spark.createDataFrame(wish, "mix_id int, source string, target_share double, max_uses int, size_ratio double")
    used, plan = P7.mix(sized, targets)
    got = used.toPandas()
    size = {d: n for d, _, n in rows}
    assert {(p["mix_id"], p["source"]) for p in plan if p["short"]} == {(m, s) for m, s, share, uses, ratio in wish if uses * have.get(s, 0) < share * ratio * total}
    for m, s, share, uses, ratio in wish:
        part = got[(got.mix_id == m) & (got.source == s)]
        want = share * ratio * total
        given_ = sum(size[d] * u for d, u in zip(part.doc_id, part.uses, strict=True))
        assert part.uses.max() <= uses if len(part) else s == "gone"
        assert part.doc_id.is_unique and given_ <= want + 1e-6
        if uses * have.get(s, 0) < want:
            assert given_ == uses * have.get(s, 0)
        else:
            assert want - given_ < (8 if s == "same" else 1)
    again = P7.mix(sized.repartition(7), targets)[0].toPandas()
    assert sorted(map(tuple, again.values)) == sorted(map(tuple, got.values))
    assert P7.mix(sized.limit(0), targets)[0].count() == 0


def test_mix_of_long_texts(spark):
    """Texts above BUDGET are placed like others, and nothing that can be reached is missed."""
    lengths = {"long": [100_001 + 1_000 * i for i in range(10)], "pairs": [100_000, 100_000, 70_000, 70_000], "greedy": [60_000, 50_000, 50_000]}
    sized = spark.createDataFrame([(f"{s}{i}", s, n) for s, part in lengths.items() for i, n in enumerate(part)], "doc_id string, source string, n_tokens bigint")
    total = sum(map(sum, lengths.values()))
    wish = {"long": 510_005, "pairs": 200_000, "greedy": 100_000}
    targets = spark.createDataFrame([(1, s, (w + 0.5) / total, 1, 1.0) for s, w in wish.items()], "mix_id int, source string, target_share double, max_uses int, size_ratio double")
    got = P7.mix(sized, targets)[0].toPandas()
    assert got.doc_id.is_unique and got.groupby("source").n_tokens.sum().to_dict() == wish


def test_added_documents_are_as_long_as_the_source(spark):
    """Millions of lengths by counts: the rounding takes no side for long texts."""
    rng = np.random.default_rng(8)
    size = np.maximum(1, rng.lognormal(6, 1.2, 20_000).astype(int))
    sized = spark.createDataFrame([(i, "a", int(n)) for i, n in enumerate(size)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([(1, "a", 0.4, 1, 1.0)], "mix_id int, source string, target_share double, max_uses int, size_ratio double")
    got, plan = P7.mix(sized, targets)
    got = got.toPandas()
    assert got.n_tokens.sum() == int(0.4 * size.sum()) == plan[0]["given"] and not plan[0]["short"]
    assert abs(got.n_tokens.mean() / size.mean() - 1) < 0.05
    f = np.full(1000, 0.4)
    more = P7._by_remainder(200_000, np.arange(1, 1001), f, rng.permutation(1000), 0)
    assert abs((np.arange(1, 1001)[more]).mean() / 500 - 1) < 0.1


def test_fitted_counts_beyond_the_budget():
    assert P7.fit_counts(100_000, {60_000: 1, 50_000: 2}) == {50_000: 2}
    assert P7.fit_counts(99_999, {60_000: 1, 50_000: 2}) == {60_000: 1}
    assert P7.fit_counts(10, {}) == P7.fit_counts(10, {11: 1}) == {}


# -- reading levels

BODY = "We looked at the plan for the week and agreed that it is good enough. Please send me the list of the rooms that you need."


def mail(body, head="", kind="text/plain; charset=utf-8", how="8bit"):
    return f"From: Ann Lee <ann@x.example>\nTo: b@y.example\nSubject: hi\n{head}MIME-Version: 1.0\nContent-Type: {kind}\nContent-Transfer-Encoding: {how}\n\n{body}"


SIGNED = f"Dear Bob,\n\n{BODY}\n\nBest regards,\nAnn Lee\nTel. 555-0101\n\nNOTE: This message and any attachments are confidential and intended solely for the addressee."
HTML = f"<html><head><style>p {{x}}</style></head><body><p>Dear Bob,</p><p>{BODY}</p><blockquote type='cite'>Old <blockquote>older</blockquote> words</blockquote></body></html>"


@pytest.mark.parametrize("raw", [
    mail(BODY), mail(SIGNED), mail(SIGNED).replace("\n", "\r\n"), mail(f"{BODY}\n-- \nAnn"), mail(f"> old words\n\n{BODY}\n\n> more old\n"), mail(f"On Mon, 1 Jan 2024 10:00:00 +0000,\nBob Ray wrote:\n> old\n\n{BODY}"),
    mail(f"{BODY}\n\n-----Original Message-----\nFrom: Bob\nSubject: x\n\nOld words here."), mail(f"{BODY}\n\n________________________________\nFrom: Bob\nSent: Monday\nSubject: x\n\n> q\n\nOld words here."),
    mail(f"{BODY}\n\n---------- Forwarded message ----------\nFrom: Bob\n\nOld words."), mail(base64.b64encode(SIGNED.encode()).decode(), how="base64"), mail(quopri.encodestring(SIGNED.encode()).decode(), how="quoted-printable"),
    mail(HTML, kind="text/html; charset=utf-8"), mail(f"--b\nContent-Type: text/plain\n\n{SIGNED}\n--b\nContent-Type: text/html\n\n{HTML}\n--b--\n", kind='multipart/alternative;\n boundary="b"'),
    mail(f"--b\nContent-Type: text/plain\n\n{BODY}\n--b\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\nAttached words.\n", kind="multipart/mixed; boundary=b"), BODY, f"﻿{mail(BODY)}",
])
def test_own_words(raw):
    text, auto = own_text(raw)
    assert " ".join(text.split()) == BODY and not auto


@pytest.mark.parametrize("raw", [None, "", "   ", "  "])
def test_own_words_of_nothing(raw):
    assert own_text(raw)[0].strip() == ""


def test_reports_are_automatic():
    log = "\n".join(f"  ok   step-{i} {i}.5s" for i in range(9))
    assert own_text(mail(log).replace("Ann Lee <ann", "Build Runner <build-runner"))[1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("From: \n->|<b=?\"';%&\r\tContent-Type:multipart/mixed;boundary=b--é")), max_size=200))
def test_own_words_of_rubbish(raw):
    own_text(raw)


def test_levels_learn_from_ratings(spark):
    rng = np.random.default_rng(0)
    stock = {1: "cat dog hat sun red big ran", 2: "garden kitchen button window basket river early", 3: "schedule supplier budget contract meeting delivery invoice", 4: "consideration implementation preliminary institutional deliberation accountability", 5: "heteroscedasticity multicollinearity stoichiometric renormalisation quasiconvexity"}
    text = lambda lv, n=60: " ".join(rng.choice(stock[lv].split() + ["the", "of", "and", "is"], n)) + "."
    docs = [(i, mail(text(1 + i % 5))) for i in range(300)] + [(400, None), (401, ""), (402, mail("short text")), (403, mail(" ".join(["el perro de la casa que no se lo con los"] * 5)))]
    labels = [(i, f" Rater_{i % 3}", 1 + i % 5) for i in range(150)] + [(0, "rater 0", 1), (7, "x", None), (9, "y", 99), (None, "z", 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("theta", F.lit(0))
    model = P8.fit(df, spark.createDataFrame(labels, "doc_id bigint, rater string, reading_level int"))
    got = {r["doc_id"]: r for r in P8.reading_levels(df, model).collect()}
    assert len(got) == len(docs)
    right = np.mean([got[i]["level"] == 1 + i % 5 for i in range(150, 300)])
    assert right > 0.9 and all((got[i]["level"] >= 4) == (i % 5 >= 3) for i in range(300))
    assert all(got[i]["level"] is None for i in (400, 401, 402, 403)) and not got[403]["english"]


def test_levels_without_ratings(spark):
    df = spark.createDataFrame([(1, mail(BODY))], "doc_id bigint, text string")
    model = P8.fit(df, spark.createDataFrame([], "doc_id bigint, rater string, reading_level int"))
    assert model == {} and P8.reading_levels(df, model).first()["level"] is None


def test_ratings_count_a_rater_once(spark):
    df = spark.createDataFrame([(1, "A b", 2), (1, "a_B ", 2), (1, "c", 4), (2, None, 3), (3, "a", None)], "doc_id bigint, rater string, reading_level int")
    assert {r["doc_id"]: r["rating"] for r in P8.ratings(df).collect()} == {1: 3.0, 2: 3.0}


def test_held_out_ratings(spark, data):
    """Half of the rated mails fit the model; the others are placed on the right side of level 4."""
    from metricloom.llm.shared import cut

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/reading_labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    placed = cut(P8.reading_levels(docs, P8.fit(docs, labels.where(half))))
    test = P8.ratings(labels.where(~half)).join(placed, "doc_id").where("level is not null").collect()
    assert np.mean([(r["level"] >= 4) == (r["rating"] > 3.5) for r in test]) >= 0.95


def test_item_parameters_maximise_the_likelihood():
    """Presence and absence both count: the fitted parameters come back from drawn mails."""
    rng = np.random.default_rng(2)
    level, length = rng.uniform(1, 5, 4000), rng.integers(10, 20, 4000)
    at = np.round(level / 0.05).astype(int)
    mails = np.zeros((len(P8.GRID), P8.LENGTHS))
    np.add.at(mails, (at, length), 1)
    beta, slope = np.array([-2.0, -1.0, 0.5]), np.array([0.8, -0.6, 0.0])
    p = 1 / (1 + np.exp(-(beta[:, None] + slope[:, None] * (P8.GRID[at] - 3) + P8._shift()[length])))
    there = rng.random(p.shape) < p
    b, s = P8.fit_items(there.sum(1).astype(float), (there * (P8.GRID[at] - 3)).sum(1), mails)
    assert np.abs(b - beta).max() < 0.2 and np.abs(s - slope).max() < 0.1
    none = P8.absent(b, s)
    assert none[20, 12] == pytest.approx(np.log1p(np.exp(b + s * (P8.GRID[20] - 3) + P8._shift()[12])).sum())
    got = P8.best_level(there.T @ s, length, none)
    assert np.corrcoef(got, level)[0, 1] > 0.3
    held = P8.best_level(there.T @ s, length, none, level)
    assert np.abs(held - level).max() < 0.2
