"""Token ids, packing, histogram, fingerprints, rules and the classifiers on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import langid, quality_cnn, rules, simhash, substrings, suffix_sort, tokens, toxicity
from docloom.llm.bytes_hash import PrefixHash

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
LONG = " ".join(random.Random(3).choices(WORDS, k=60_000))
TEXTS = [None, "", " \n\t ", "one", "It's THE end... of <|endoftext|> 12é!", "no-space" * 4000, LONG, "copy me twice please", "copy me twice please", "日本語 ñ ß 😀"]
CLASHING = ("score", "fp", "row", "root", "component_id", "text_key", "key", "n_words", "kept", "start", "found", "many")


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts with repeated and null ids and columns named like the operators' own."""
    rows = [(None if k == 3 else k // 2, t, "en" if k % 2 else None) for k, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return frame.withColumns({c: F.lit(1) for c in CLASHING})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_ids_are_the_tokenizers(spark):
    plain = Tokenizer.from_file(PATH)
    texts = [t or "" for t in TEXTS] + ["K x's. a1b2. ' 's ''s don't.,; (x). <|ENDOFTEXT|> ﬁ İ ΑΣ."]
    ids, each = tokens.encoder(PATH).encode(pa.array(texts))
    expected = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert each.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_packing_round_trip(spark, docs):
    plain = Tokenizer.from_file(PATH)
    rows = tokens.pack(docs.drop("start"), PATH, longest=64).orderBy("sequence_id").collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    got, text = [], []
    for r in rows:
        assert r["length"] == r["bucket"] == 1 << int(r["length"]).bit_length() - 1 <= 64 and r["offset"] == 0
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["start"] == len(text)
        text += ids
        if len(text) == r["doc_tokens"]:
            got.append((r["doc_id"], tuple(text)))
            text = []
    expected = [(d["doc_id"], (*plain.encode(d["text"] or "", add_special_tokens=False).ids, 1)) for d in docs.collect()]
    assert Counter(got) == Counter(expected)
    assert tokens.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tokens.pack(docs, PATH, longest=100)


def test_length_table_answers_every_limit(spark, docs):
    plain = Tokenizer.from_file(PATH)
    sizes = [len(plain.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    table = tokens.length_table(tokens.length_counts(docs, PATH), block=4)
    rows = {r["tokens"]: r for r in table.collect()}
    assert set(rows) == set(sizes)
    for n, r in rows.items():
        assert r["n_docs"] == sizes.count(n) and r["docs_at_least"] == sum(s >= n for s in sizes)
        assert r["tokens_below"] == sum(s for s in sizes if s < n)
        assert r["truncated_tokens"] == sum(min(s, n) for s in sizes) and r["total_tokens"] == sum(sizes)
    limits = {r["limit"]: (r["kept_tokens"], r["cut_docs"]) for r in tokens.truncated_totals(table, [0, 2, 7, 10**6]).collect()}
    assert limits == {c: (sum(min(s, c) for s in sizes), sum(s > c for s in sizes)) for c in (0, 2, 7, 10**6)}
    for share in (0.1, 0.5, 0.9, 1.0):
        assert table.agg(tokens.length_quantile(share)).first()[0] == sorted(sizes)[int(np.ceil(share * len(sizes))) - 1]
    assert tokens.length_table(tokens.length_counts(docs.limit(0), PATH)).count() == 0


def plain_fingerprint(text, size=3):
    own = [w.encode() for w in words_of("".join(c.lower() if c.isascii() else c for c in text or ""))]
    grams = [b" ".join(own[k:k + size]) for k in range(max(1, len(own) - size + 1))] if own else []
    bits = [sum(xxhash.xxh64_intdigest(g, seed=42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def plain_groups(values):
    group = list(range(len(values)))
    for i, x in enumerate(values):
        for j in range(i):
            if bin(x ^ values[j]).count("1") <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def plain_components(values, ids):
    group = plain_groups(values)
    return [min((ids[j] for j in range(len(ids)) if group[j] == g and ids[j] is not None), default=None) for g in group]


def test_near_duplicates_of_awkward_rows(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"][:3000] if r["text"] == LONG else r["text"]) for r in rows]
    got = simhash.near_duplicates(docs).collect()
    expected = Counter(zip((r["doc_id"] for r in rows), plain_components(prints, [r["doc_id"] for r in rows])))
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == expected
    own = {r["doc_id"]: r["fingerprint"] for r in got}
    assert own[0] == "0" * 16 and own[None] == f"{plain_fingerprint('one'):016x}"
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    heads = dict(zip(plain_groups(prints), plain_components(prints, [r["doc_id"] for r in rows])))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(heads.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_every_pair_within_three_bits_is_connected(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base[:6]:
        for flips in (1, 2, 3, 3, 3, 4, 5):
            values.add(b ^ sum(1 << k for k in rng.sample(range(64), flips)))
    dense = {base[7] ^ m for m in range(64)}  # many neighbours of each other
    values = sorted(values | dense)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    found = {r["fp"] for r in simhash.crowded(fps).collect()}
    must = {s[0] for s, v in zip(signed, values) if any(v != w and bin(v ^ w).count("1") <= 3 for w in values)}
    assert must <= found
    marked = fps.withColumn("id", F.monotonically_increasing_id())
    roots = {r["fp"]: r["component_id"] for r in simhash.groups(marked, "id").collect()}
    ids = {r["fp"]: r["id"] for r in marked.collect()}
    own = [ids[s[0]] for s in signed]
    assert [roots[s[0]] for s in signed] == plain_components(values, own)


def test_rule_counts(spark, docs):
    extra = spark.createDataFrame([(50, "a b c a b c a b c d\n\n x#|> \nq\nq\n  \nq", "en"), (51, "a\x0bb c a\x0bb c z", None)], "doc_id long, text string, lang string")
    whole = docs.select("doc_id", "text", "lang").union(extra)
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.counts(whole).collect())
    expected = Counter()
    for r in whole.collect():
        text, own = r["text"] or "", words_of(r["text"])
        triples = [tuple(own[k:k + 3]) for k in range(len(own) - 2)]
        many = Counter(triples)
        covered = {k + j for k, t in enumerate(triples) if many[t] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        expected[(r["doc_id"], len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))] += 1
    assert got == expected
    assert rules.screen(whole.limit(0), whole.limit(0).select("doc_id")).count() == 0


def test_binomial_tail_is_exact(spark):
    from math import comb
    for n, k, risk in ((20, 0, 0.05), (100, 2, 0.05), (400, 7, 0.0125), (1000, 30, 0.05), (50, 20, 0.05)):
        got = spark.range(1).select(rules.binomial_tail(F.lit(n), F.lit(k), risk)).first()[0]
        exact = sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))
        assert got == (1.0 if k >= n * risk else pytest.approx(exact, rel=1e-9))


def test_cutoffs_hold_the_risk_in_every_stratum(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(WORDS, k=60)) + (" # # #" * rng.choice((0, 0, 0, 9)) if k % 2 else ""), "b" if k % 2 else "a") for k in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    features = rules.counts(docs, stratum=F.col("lang")).cache()
    found = {(r["stratum"], r["rule"]): r for r in rules.cutoffs(features, docs.select("doc_id"), risk=0.05).collect()}
    assert found["a", "symbols_per_word"]["cutoff"] == min(rules.RULES["symbols_per_word"])
    for r in found.values():
        assert r["n_rejected"] <= 0.05 * r["n_good"]
    # A quarter of stratum b has symbols: no cutoff below its ratio is certified.
    assert found["b", "symbols_per_word"]["cutoff"] > 27 / 87
    verdicts = rules.screen(docs, docs.select("doc_id"), stratum=F.col("lang"))
    assert verdicts.where("not kept").count() <= 0.05 * 1600


def test_classifiers_learn_and_take_any_row(spark, docs):
    rng = random.Random(1)
    bad = [(" ".join(rng.choices(WORDS, k=40) + rng.choices(["grumplish", "snorkwad"], k=3)), 1) for _ in range(60)]
    good = [(" ".join(rng.choices(WORDS, k=40)), 0) for _ in range(200)]
    model = toxicity.fit(bad + good)
    scores = model.score(pa.array([t for t, _ in bad[:20] + good[:20]] + ["alpha beta grumplissh snorkwadd gamma " * 3, LONG]))
    assert (scores[:20] > 0.7).all() and (scores[20:40] < 0.3).all() and scores[40] > 0.7 and scores[41] < 0.3
    junk = [("".join(rng.choices("#|%$ 0x", k=300)), 0) for _ in range(60)]
    cnn = quality_cnn.fit([(t, 1) for t, _ in good] + junk, epochs=6)
    scored = cnn.score(pa.array([good[0][0], junk[0][0], good[1][0] * 50 + junk[1][0] * 20]), cnn.pairs())
    assert scored[0] > 0.7 and scored[1] < 0.3 and scored[2] < scored[0]
    for frame in (toxicity.score(docs, model), quality_cnn.score(docs, cnn), toxicity.score(docs, toxicity.fit([])), quality_cnn.score(docs, quality_cnn.fit([("a", 1)]))):
        rows = frame.collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0
    labelled = docs.select("text", F.lit(1).alias("label"))
    assert toxicity.fit_in_task(labelled.limit(0)).bias == 0 < toxicity.fit_in_task(labelled.where("text is not null")).bias


def test_pooling_covers_whole_texts():
    texts = pa.array(["", "a", "ab" * 1000, "x" * 256, "y" * 257])
    chunks, valid, firsts = quality_cnn.chunked(texts)
    for k, t in enumerate(texts.to_pylist()):
        own = chunks[firsts[k]:firsts[k + 1] if k + 1 < len(firsts) else None]
        assert valid[firsts[k]:firsts[k] + len(own)].sum() == max(1, len(t))
        assert b"".join(bytes(c[:quality_cnn.CHUNK]) for c in own).rstrip(b"\0") == t.encode()


def test_language_model(spark, docs):
    rng = random.Random(2)
    rows = [(k, " ".join("".join(rng.choices("aeioubcd" if k % 2 else "xyzwkjqv", k=5)) for _ in range(8)), "v" if k % 2 else "c") for k in range(60)]
    rows += [(60, None, "v"), (61, "aei", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(train, F.col("doc_id") % 4 != 2)
    assert model.names == ["c", "v"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(train, model).collect()}
    assert all(got[k][0] == lang for k, _, lang in rows[:60]) and got[60] == ("und", 0.0)
    out = langid.predict(docs, model).collect()
    assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out)
    empty = langid.train(train.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.train(train, F.lit(True), max_languages=1)


def test_pieces_hold_every_character_once():
    from docloom.llm.common import pieces
    texts = ["", "ab cd", "x" * 95, "word " * 60, "last"]
    whole, sizes = [""] * len(texts), []
    for owner, part in pieces(pa.array(texts), 40):
        sizes.append(sum(map(len, part.to_pylist())))
        for k, p in zip(owner, part.to_pylist()):
            whole[k] += p
    assert whole == texts and max(sizes) < 80
    model = toxicity.fit([("bad bad word", 1)] * 9 + [("good fine word", 0)] * 20)
    long = "good fine bad word " * 120_000
    assert model.score(pa.array([long]))[0] == pytest.approx(model.score(pa.array(["good fine bad word " * 60_000]))[0], abs=1e-3)


def test_suffix_sort_against_plain_sort():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2500] = data[100:600]
    starts = rng.permutation(3900)[:1200]
    groups = np.sort(rng.integers(0, 9, 1200))
    for limit in (1, 7, 60):
        order = suffix_sort.sort_suffixes(PrefixHash(data), starts, groups, limit)
        raw = data.tobytes()
        key = lambda k: (groups[k], raw[starts[k]:starts[k] + limit])  # noqa: E731,B023
        assert [key(k) for k in order] == sorted(map(key, range(1200))) and sorted(order) == list(range(1200))
        many = Counter(map(key, range(1200)))
        assert suffix_sort.repeated(PrefixHash(data), starts, groups, limit).tolist() == [many[key(k)] > 1 for k in range(1200)]


def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    many = Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        covered = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if many[b[k:k + length]] > 1:
                covered[k:k + length] = True
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((len(b), int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_repeated_bytes(spark, docs, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rng = random.Random(8)
    piece = lambda n: " ".join(rng.choices(WORDS, k=n))
    passage, copied = piece(70), piece(90)
    texts = [piece(30) + passage[k:400 - k] + piece(40) for k in range(0, 40, 7)]
    texts += [copied, copied, copied[:250], "ab" * 300, "é" * 150, None, "", "short", passage[:199], passage[:200], passage]
    frame = spark.createDataFrame([(k % 9, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("kept", F.lit(1))
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in substrings.remove_repeats(frame).collect())
    assert got == Counter(plain_removal(texts, 200))
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def test_folds_are_the_text_crc(spark):
    from docloom.llm.common import fold
    rows = spark.createDataFrame([(5,), (None,), (123456,)], "doc_id long").select("doc_id", fold("doc_id", 3).alias("f")).collect()
    assert [r["f"] for r in rows] == [None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in rows]
