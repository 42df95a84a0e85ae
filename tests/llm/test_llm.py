"""The training-text operators against brute force, round trips and held-out accuracy, with the awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from eventframe.llm import (
    boosting,
    bpe,
    chat,
    decontamination,
    embeddings,
    graph,
    language,
    linededup,
    neardup,
    pii,
    quality,
    queries,
    toxicity,
    words,
)

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
AWKWARD = [None, "", " ", "\n\n", "a", "word " * 30_000, "x" * 50_000, "é🙂 ñ", "same", "same"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, repeated rows, empty and long texts, and a column named like a result."""
    rows = [(i if i % 4 else None, t, None, "s", i, 1) for i, t in enumerate(AWKWARD)] + [(3, "\n\n", None, "s", 3, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long, score int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 0, 1), (5, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingle_set(text, k):
    w = split_words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingles(k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ab AB\t\né1 ") for _ in range(rng.randrange(60))) for _ in range(1500)] + [None, "", " "]
    there, back = {}, {}
    for t, s in zip(texts, words.shingles(pa.array(texts), k), strict=True):
        w = split_words(t)
        want = [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])
        assert len(want) == len(s)
        for a, b in zip(want, s.tolist(), strict=True):
            assert there.setdefault(a, b) == b and back.setdefault(b, a) == a


# -- pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, hit):
    digits = [int(c) for c in hit if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        doubled = [d * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return 10 <= len(digits) <= 15 if kind == "phone" else True


def test_pii_base(spark):
    rng = random.Random(3)
    parts = ["a", "b1", ".", "@", "12", " ", "-", "+1", "5", "(", ")", "255", "0", "4111 1111 1111 1111", "4111111111111111", "é", "🙂",
             "x@y.z", "+1 (555) 123-4567", "[at]", "[dot]"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(800)]
    rows += [(5000, None), (5001, ""), (5002, "1." * 20_000), (5003, "a@" + "b." * 20_000 + "c"), (5004, "1 " * 20_000)]
    got = {r["doc_id"]: r for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], t or "") if passes(kind, m.group()))
        text = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i]["spans"].split(","))


def test_pii_redacts(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de or +1 (555) 123-4567."), (2, None)], "doc_id long, text string")
    model = pii.train(pii.propose(df))
    assert [r["text"] for r in pii.redact(df, model).orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE].", ""]


def checked_number(rng, digits):
    for last in range(10):
        number = "".join(rng.choice("0123456789") for _ in range(digits - 1)) + str(last)
        if passes("card", number):
            return number
        rng.random()
    return checked_number(rng, digits)


def test_pii_adds_spans_by_its_trees(spark):
    """National numbers, written-out addresses, dotted cards and cards in a row of numbers are found; decoys of other shapes are not."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))       # noqa: E731
    word = lambda kind: {"phone": "tel ", "email": "mail ", "ip": "host "}[kind] if rng.random() < 0.8 else "ok "        # noqa: E731
    rows, wanted, decoys = [], set(), set()
    for i in range(4800):
        card = checked_number(rng, 16)
        kind, before, hit = [
            ("phone", word("phone"), f"+49 ({digits(3)}) {digits(7)}"),
            ("email", word("email"), f"a{digits(2)}@b.org"),
            ("card", "ok ", card),
            ("phone", word("phone"), f"0{digits(3)}/{digits(3)}-{digits(3)}"),
            ("email", word("email"), f"c{digits(2)} (at) d (dot) org"),
            ("card", "ok ", ".".join(card[j:j + 4] for j in range(0, 16, 4))),
            (None, "ok ", digits(8)),
            (None, "ok ", f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}"),
        ][i % 8]
        if kind is None and passes("card", hit):
            continue
        if i % 8 > 2:
            (wanted if kind else decoys).add((i, f"{kind}:{len(before)}:{len(before) + len(hit)}" if kind else len(before)))
        rows.append((i, before + hit + " end"))
    for i in range(8000, 8100):
        rows.append((i, f"ok {checked_number(rng, 16)} {checked_number(rng, 16)} end"))
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(span in got[i] for i, span in wanted)
    missed = {s.split(":")[0] for i, s in wanted if s not in got[i]}
    assert found >= 0.9 * len(wanted), missed
    wrong = sum(bool(got[i]) for i, _ in decoys)
    assert wrong <= 0.05 * len(decoys)
    assert sum("card:3:19" in got[i] for i in range(8000, 8100)) >= 85


def test_pii_refuses_without_signs(spark):
    rng = random.Random(2)
    rows = [(i, "ok " + "".join(rng.choice("0123456789") for _ in range(16))) for i in range(400)]
    rows = [(i, t) for i, t in rows if not passes("card", t[3:])] + [(1000, "ok +49 (555) 1234567")]
    got = pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(bool(r["spans"]) for r in got) == 1


def test_pii_awkward_and_empty(spark, awkward):
    out = pii.pii(awkward)
    assert out.count() == awkward.count() and pii.pii(awkward.limit(0)).collect() == []


# -- embeddings

def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((60, 16))
    rows = [(i, (centre[i % 60] + rng.standard_normal(16) * 0.04).tolist(), i % 2 if i % 7 else 0) for i in range(500)]
    rows += [(500 + i, (centre[0] + rng.standard_normal(16) * 0.02).tolist(), 1) for i in range(200)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, rows[0][1], None), (905, rows[1][1], rows[1][2]), (906, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    good = [(i, np.float32(v).astype(float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    x = np.stack([g[1] / np.linalg.norm(g[1]) for g in good])
    lab = np.array([g[2] for g in good])
    links = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(links, False)
    found = sum(got[g[0]]["n_links"] for g in good)
    assert len(got) == len(rows)
    assert 0.9 * links.sum() <= found <= links.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, 906))


def test_embedding_audit_sees_missed_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    big = [(i, base + rng.standard_normal(32) * 0.02) for i in range(300)]
    pairs = [(1000 + 2 * i + k, c + rng.standard_normal(32) * 0.01 * k) for i, c in enumerate(rng.standard_normal((60, 32))) for k in (0, 1)]
    points = spark.createDataFrame([(i, 0, (v + 0.0).tobytes()) for i, v in big + pairs], "node long, part long, v binary")
    known = spark.createDataFrame([(i, 0) for i, _ in big], "node long, component long")
    assert embeddings.recall(points, known) < embeddings.RECALL
    every = known.unionByName(spark.createDataFrame([(i, i - i % 2) for i, _ in pairs], "node long, component long"))
    assert embeddings.recall(points, every) == 1


def test_embedding_components_joined_by_a_bridge_between_full_lists(spark):
    """Two tight groups, larger than the longest list, that one link at the threshold joins."""
    rng = np.random.default_rng(4)
    axis = np.eye(24)
    turn = lambda degrees: np.cos(np.radians(degrees)) * axis[0] + np.sin(np.radians(degrees)) * axis[1]
    rows = [turn(0), turn(11.3)]
    for i in range(140):
        rows.append(turn(-4 if i % 2 else 15.3) + np.r_[0, 0, rng.standard_normal(22)] * 0.008)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    x = np.stack([v / np.linalg.norm(v) for v in rows])
    assert ((x @ x.T >= 0.98)[0].sum(), (x @ x.T >= 0.98)[1].sum()) == (72, 72)
    assert {r["component_id"] for r in embeddings.near_duplicates(df).collect()} == {0}


def test_embedding_open_links_between_blocks(spark):
    """Pairs of one group that fall in different blocks are found, whichever component has most of the group."""
    rng = np.random.default_rng(6)
    c = rng.standard_normal((900, 16))
    rows = [(2 * i + k, (v + rng.standard_normal(16) * 0.01 * k).tobytes()) for i, v in enumerate(c) for k in (0, 1)]
    points = spark.createDataFrame(rows, "node long, v binary")
    groups = points.select(embeddings.F.lit(5).cast("long").alias("g"), "node")
    known = spark.createDataFrame([(i, 0) for i in range(0, 1200, 2)], "node long, component long")
    got = embeddings.components(embeddings.open_links(groups, points, known).unionByName(known.selectExpr("node u", "component v")))
    of = {r["node"]: r["component"] for r in got.collect()}
    assert all(of[2 * i] == of[2 * i + 1] for i in range(900)) and len({of[2 * i] for i in range(600, 900)}) == 300


# -- language

@needs_data
def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in language.language_id(docs).collect() if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_awkward(spark, awkward):
    out = language.language_id(awkward).collect()
    assert len(out) == awkward.count() and {r["lang_pred"] for r in out} == {"und"}
    assert language.keep_identified(awkward, language.Profiles([("en", int(g), i) for i, g in enumerate(language.top(language.grams(language.sequence("same word"))))])).count() == 6
    assert language.language_id(awkward.limit(0)).count() == 0


# -- bpe

def test_bpe_equals_the_library(spark, awkward):
    vocab = bpe.vocabulary(queries.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.rank, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "'s", "'ll", "1", "²", "!", "\t", "\x1c", "　", "語", "🙂", "ing", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)] + [" a", "a ", "\n a", "ab" * 700 + "é" * 600, "<|endoftext|>"]
    rows = list(enumerate(texts)) + [(10**6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = bpe.encode(df, queries.VOCABULARY, public_tokenizers.PATTERN)
    back = {r["doc_id"]: r for r in bpe.decode(encoded, queries.VOCABULARY).collect()}
    for i, t in rows:
        assert back[i]["ids"] == own.encode_ordinary(t or "")
        assert bytes(back[i]["decoded"]) == (t or "").encode()
    digest = bpe.digest(awkward, queries.VOCABULARY, public_tokenizers.PATTERN).collect()
    assert sorted(r["n_tokens"] for r in digest) == sorted(len(own.encode_ordinary(r["text"] or "")) for r in awkward.collect())


# -- classifiers

def test_lasso_drops_noise():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 6)).astype(float)
    w, _ = boosting.logistic(x, x[:, 2], np.ones(2000), lasso=0.01)
    assert w[2] > 1 and np.abs(np.delete(w, 2)).max() < 0.05


@needs_data
@pytest.mark.parametrize(("name", "target", "parts", "rest"), [("op5_quality", "quality", 3, 1), ("op7_toxicity", "toxic", 5, 0)])
def test_classifiers_on_held_out_rows(spark, name, target, parts, rest):
    sf = SF.replace("0.001", "0.1")
    got = queries.QUERIES[name](spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", target)
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert rows and sum(r["predicted"] == r[target] for r in rows) >= 0.95 * len(rows)
    import zlib
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % parts == rest) for r in rows)


def test_classifiers_awkward(spark, awkward, labels):
    for out in (quality.quality(awkward, labels), toxicity.toxicity(awkward, labels), quality.quality(awkward.limit(0), labels), toxicity.toxicity(awkward, labels.limit(0))):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.collect())
    assert quality.quality(awkward, labels).count() == awkward.count()


def test_label_model_ranks_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    v = np.stack([np.where(truth, rng.random(4000) < 0.9, rng.random(4000) < 0.05) for _ in range(4)] + [rng.random(4000) < 0.3], 1)
    patterns, n = np.unique(v, axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns, n)
    gap = model.rates[1] - model.rates[0]
    assert gap[:4].min() > 0.6 and abs(gap[4]) < 0.2
    assert ((model.posterior(v.astype(float)) > 0.5) == truth).mean() > 0.95


# -- line dedup

def repeated(texts, run):
    """Lines of all windows of whole lines with at least ``run`` words that occur at an earlier place."""
    seen, out = set(), {}
    for i in sorted(texts):
        lines = [(x.strip(" "), p) for p, x in enumerate((texts[i] or "").split("\n")) if x.strip(" ")]
        gone = set()
        for a in range(len(lines)):
            size = 0
            for b in range(a, len(lines)):
                size += lines[b][0].count(" ") + 1
                if size >= run:
                    key = tuple(x for x, _ in lines[a:b + 1])
                    if key in seen:
                        gone.update(p for _, p in lines[a:b + 1])
                    seen.add(key)
        out[i] = len(gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice("abcdefghijklmnop") * 2 + str(rng.randrange(999)) for _ in range(n))
    passages = ["\n".join(line(rng.randrange(6, 70)) for _ in range(rng.randrange(1, 6))) for _ in range(12)]
    texts = {}
    for i in range(120):
        parts = [line(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 5))] + ([rng.choice(passages)] if rng.random() < 0.5 else [])
        rng.shuffle(parts)
        texts[i] = "\n".join(parts)
    texts[200], texts[201] = texts[7], "\n".join([line(12)] * 30)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["_llm_deleted"] for r in linededup.without_repeated_lines(df).collect()}
    assert got == repeated(texts, linededup.RUN)


def test_line_dedup_of_runs_that_share_parts(spark):
    """Runs of which parts occurred before in other company: the first place of a fingerprint is often not the place to compare."""
    rng = random.Random(8)
    pool = [" ".join(f"l{i}w{k}" for k in range(rng.randrange(4, 34))) for i in range(40)]
    texts = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))) for i in range(150)}
    for i in range(150, 400):
        at = rng.randrange(34)
        cut = pool[at:at + rng.randrange(2, 7)]
        texts[i] = "\n".join([rng.choice(pool), *cut, rng.choice(pool)] if rng.random() < 0.6 else [f"own {i}", *cut])
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["_llm_deleted"] for r in linededup.without_repeated_lines(df).collect()}
    assert got == repeated(texts, linededup.RUN)


def test_line_dedup_awkward(spark, awkward):
    out = linededup.without_repeated_lines(awkward)
    assert out.columns == [*awkward.columns, "_llm_lines", "_llm_deleted"]
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in awkward.collect())
    assert linededup.digest(awkward.limit(0)).count() == 0


def test_line_dedup_of_passages_inside_lines(spark):
    """Passages of 100 words that begin and end in mid-line, cut into lines elsewhere than in their first place."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdehinorsty") for _ in range(rng.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(100) for _ in range(20)]
    texts = {i: f"{text(9)} {p} {text(8)}\n{text(20)}" for i, p in enumerate(passages)}
    own = {i: [text(7), text(6)] for i in range(100, 120)}
    texts |= {i: f"{a} {passages[i - 100]}\t{b}" for i, (a, b) in own.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.without_repeated_lines(df).collect()}
    assert all(got[i] == texts[i] for i in range(20))
    assert all(got[i] == f"{a} {b}" for i, (a, b) in own.items())


# -- decontamination

def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: " ".join("w%d" % rng.randrange(4000) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 5, 9, 14, 40, 130]))) for i in range(60)] + [(60, None), (61, ""), (0, "again " * 9)]
    docs = []
    for i in range(300):
        body = text(rng.randrange(1, 900)).split()
        if rng.random() < 0.5:
            cut = items[rng.randrange(60)][1].split()
            if rng.random() < 0.4 and len(cut) > 10:
                cut[rng.randrange(len(cut))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = cut
        docs.append((i, " ".join(body)))
    docs += [(1000, None), (1001, "")]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = sorted((d, i) for d, t in docs for own in [shingle_set(t, 5)] for i, x in items for q in [shingle_set(x, 5)] if q and len(q & own) >= 0.8 * len(q))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == want and want


# -- near dedup

def test_near_dedup_against_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: ["w%d" % rng.randrange(3000) for _ in range(n)]
    bases = [text(rng.randrange(1, 120)) for _ in range(40)]
    docs = []
    for i in range(400):
        w = list(bases[0 if rng.random() < 0.4 else rng.randrange(40)])
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "v%d" % rng.randrange(99)
        docs.append((i, " ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, " "), (1003, docs[0][1]), (1003, docs[0][1])]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80).collect()
    sets = [shingle_set(t, 2) for _, t in docs]
    part = list(range(len(docs)))
    for x in range(len(docs)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and 100 * both >= 80 * len(sets[x] | sets[y]) and part[x] != part[y]:
                part = [part[y] if p == part[x] else p for p in part]
    least = {}
    for (i, _), p in zip(docs, part, strict=True):
        least[p] = min(i, least.get(p, i))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(
        (i, len(s), least[p]) for (i, _), s, p in zip(docs, sets, part, strict=True))


def test_near_dedup_awkward(spark, awkward):
    kept = neardup.distinct_documents(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["text"])[:9] for r in kept.collect()) == sorted(str(t)[:9] for t in AWKWARD[:9])
    assert neardup.near_duplicates(awkward.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)]
    part = {n: n for link in links for n in link if link[0] != link[1]}
    for a, b in links:
        if a != b and part[a] != part[b]:
            low, high = sorted((part[a], part[b]))
            part = {n: low if p == high else p for n, p in part.items()}
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == part


# -- chat

def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\\\[\\INST]", "<<s>", None, "", "[TURN]", "a\nb", "[OUT][ROLE][/ROLE]<s>"]
    rows = [(c, t, ["user", "assistant", "system", None, "[TURN]\\"][(c * t) % 5 if c % 3 else t % 2], said[(c + t) % len(said)]) for c in range(12) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(chat.with_probe(df))).collect()}
    rows += [(-1, 0, "user", said[0]), (-1, 1, "assistant", said[0])]
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


# -- pipeline

@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
    left = {r["doc_id"] for r in now.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == left and len(out) == len(left) < docs.count()
