"""Quality, language, toxicity, BPE, token counts and packing."""

import collections
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkgml.llm.bpe import SpeculativeBpe, bpe_round_trip
from sparkgml.llm.language import Ranker, fit_profiles, language_id, ngrams, ranked, tally, with_language
from sparkgml.llm.packing import optimal_bounds, pack
from sparkgml.llm.common import joined
from sparkgml.llm.quality import CHAR_SIZES, base_counts, code_points, fit_quality, hashed_families, quality_rules
from sparkgml.llm.tokens import LONG_SPACE, attribute, encode, encoding, sections_of, token_counts, token_ends
from sparkgml.llm.toxicity import AIMED, BARE, DENIED, MACHINES, MENACE, QUOTED, STOP, TARGET, ToxicityGrammar, composed, fit_toxicity, learn_insults, outcome_of, outcomes, paired, toxicity

SF = "/root/testdata/sf0.1"
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "12 34 !!"), (5, "word " * 50_000), (5, "word " * 50_000), (None, "Some words here"), (6, "ünïcode ñandú 漢字 👍")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1.0, 2, None) for i, t in docs], "doc_id long, text string, lang_pred string, score double, n_tokens int, kept string")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_base_counts():
    rng = random.Random(1)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice(["a", "b", " ", "\n", "é", "#", " ", "\x0b", "<"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    got = base_counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(t), t[:50]


def test_character_ngrams():
    """n-grams are of characters, whatever bytes these have, and stay within their text."""
    texts = ["aé漢👍é", "", "abc", "漢", "é漢é漢é"]
    data, offsets = joined([t.encode() for t in texts])
    assert code_points(data).tolist() == [ord(c) for c in "".join(texts)]
    for n, (owner, bucket) in zip(CHAR_SIZES, hashed_families(data, offsets), strict=False):
        assert np.bincount(owner, minlength=5).tolist() == [max(0, len(t) - n + 1) for t in texts]
        grams = [t[i : i + n] for t in texts for i in range(len(t) - n + 1)]
        assert len(set(zip(grams, bucket.tolist(), strict=True))) == len(set(grams))


def test_quality(spark, tables):
    """Accuracy on labelled rows that the fit leaves out, and calibration."""
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = fit_quality(docs, labels.where(~held))
    scored = quality_rules(docs, model).withColumnRenamed("quality", "p").join(labels.where(held).withColumnRenamed("quality", "label"), "doc_id").select("kept", "p", "label").collect()
    good, bad = [r for r in scored if r.label == 1], [r for r in scored if r.label == 0]
    assert np.mean([r.kept for r in good]) > 0.93 and np.mean([r.kept for r in bad]) < 0.15
    sure = [r for r in scored if r.p > 0.8]
    assert np.mean([r.label for r in sure]) > 0.8
    assert all(0 <= r.p <= 1 for r in scored)
    odd = quality_rules(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(r.base_failed and not r.kept for r in odd if r.doc_id in (1, 2, 3, 4, 5))
    assert quality_rules(frame(spark, []), model).count() == 0
    blank = fit_quality(docs, labels.where("false"))
    assert quality_rules(frame(spark, ODD), blank).count() == len(ODD)


def test_ngrams():
    got = dict(zip(*(x.tolist() for x in tally(ngrams("Ab ab"))), strict=True))
    assert got[ord("a")] == 2 and got[1 << 21 | ord("a")] == 2 and got[1 << 42 | ord("a") << 21 | ord("b")] == 2
    assert len(ngrams("")) == len(ngrams("12 !")) == 0
    grams, counts = np.array([5, 6, 7, 8], np.uint64), np.array([1, 3, 3, 1])
    assert ranked(grams, counts, 3).tolist() == [6, 7, 5]


def brute_language(text, profiles, top):
    counts = collections.Counter(ngrams(text).tolist())
    mine = sorted(counts, key=lambda g: (-counts[g], g))[:top]
    far = {}
    for lang, p in profiles.items():
        place = {g: i for i, g in enumerate(p.tolist())}
        far[lang] = sum(abs(place[g] - i) if g in place else top for i, g in enumerate(mine))
    best = min(far, key=lambda k: (far[k], k))
    return best, 1 - far[best] / (top * len(mine))


def test_language(spark, tables):
    docs, _ = tables
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles = fit_profiles(docs.where(~held), sample=800)
    rows = language_id(docs.where(held), profiles).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    for r in rows[:60]:
        lang, score = brute_language(r.text, profiles, 600)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-12
    odd = {r.doc_id: r for r in language_id(frame(spark, ODD), profiles).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and odd[None].lang_pred in profiles and odd[5].score > 0
    kept = with_language(frame(spark, ODD), profiles)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "6", "None"] and kept.columns == frame(spark, ODD).columns
    assert language_id(frame(spark, []), profiles).count() == 0
    strange = spark.createDataFrame([(1, "Жълтата дюля беше щастлива, че пухът, който цъфна, замръзна", None), (2, rows[0].text, None), (3, rows[1].text, "xx")], "doc_id long, text string, lang string")
    left = with_language(strange, profiles, min_score=0.2).collect()
    assert {r.doc_id: r.lang for r in left} == {2: rows[0].lang_pred, 3: "xx"}
    assert with_language(strange, {k: v[:50] for k, v in profiles.items()}, min_score=0.2).count() == 3
    assert fit_profiles(docs.where("false")) == {} and Ranker({}, 10).predict("abc") == ("und", 0.0)


def test_transducers():
    other, insult, threat, negation, report, stop, quote = 0, 1, 2, 4, 5, 6, 7
    assert outcomes([TARGET, other, insult]) == [(2, AIMED)] and outcomes([other, insult]) == [(1, BARE)]
    assert outcomes([threat]) == [] and outcomes([threat, TARGET]) == [(0, MENACE)]
    assert outcomes([negation, other, insult]) == [(2, DENIED)] and outcomes([report, TARGET, insult]) == [(2, QUOTED)]
    assert outcomes([report, stop, insult]) == [(2, BARE)] and outcomes([quote, insult, quote, insult]) == [(1, QUOTED), (3, BARE)]
    g = ToxicityGrammar()
    plain, denied, quoted = g.scores(["you are an idiot", "you are not an idiot", "they said you are an idiot"])
    assert plain > 0.5 > denied and quoted < 0.5 and g.scores([""])[0] < 0.5
    inch, word, alone, two = g.scores(['5" nails. they fit. you are an idiot. you moron.', "the word idiot is in the dictionary", "idiot", "idiot and moron"])
    assert inch > 0.5 and word < 0.5 and alone < 0.5 and two > 0.5
    stray, later, pair = g.scores(['he has a " mark\nyou are an idiot', 'a stray " mark. you are an idiot', 'it reads "you are an idiot" there'])
    assert stray > 0.5 and later > 0.5 > pair


def test_cheapest_path():
    """Against every path through the composed machines."""
    rng = random.Random(12)
    for _ in range(400):
        line = [rng.choice([0, 0, 1, 1, 2, 3, 4, 5, 6, 7]) for _ in range(rng.randint(1, 9))]
        tape = [*paired(line), STOP]
        paths = [(0.0, tuple(s for _, s in MACHINES), ())]
        for i, symbol in enumerate(tape):
            paths = [(cost + more, new, met + (((i, k),) if (k := outcome_of(symbol, marks)) is not None else ())) for cost, state, met in paths for new, marks, more in composed(state, symbol)]
        least = min(p[0] for p in paths)
        assert tuple(outcomes(line)) in {p[2] for p in paths if p[0] == least}, line
        # a target within four words, on either side and in the same clause, aims an insult
        for i, k in outcomes(line):
            near = [j for j, s in enumerate(tape) if s == TARGET and 0 < abs(i - j) <= 4 and STOP not in tape[min(i, j) : max(i, j)]]
            assert k in (DENIED, QUOTED) or (k in (AIMED, MENACE)) == bool(near), (line, i)


def test_learned_insults():
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choice(["aa", "bb", "cc", "dd"]) + str(rng.choice("xyz")) for _ in range(20))
    toxic = [f"{filler()} snarkle {filler()}" for _ in range(30)] + [f"{filler()} vorpal{rng.choice(['en', 'ig', 'os', 'um'])} companion" for _ in range(30)]
    found = dict(learn_insults(toxic, [filler() for _ in range(60)]))
    assert any("snarkle"[:4] in k for k in found) and any("vorp" in k or "companion"[:4] in k for k in found)
    assert learn_insults([], []) == []


def test_toxicity(spark, tables):
    docs, labels = tables
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    grammar = fit_toxicity(docs, labels.where(~held))
    rows = toxicity(docs, grammar).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.85 and np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.02
    odd = toxicity(frame(spark, ODD), grammar).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score < 0.5 and r.predicted == 0 for r in odd)
    assert toxicity(frame(spark, []), grammar).count() == 0
    assert toxicity(frame(spark, ODD), fit_toxicity(docs, labels.where("false"))).count() == len(ODD)


@pytest.fixture(scope="module")
def bpe():
    return SpeculativeBpe(WORDS, cache_words=2000)


def test_bpe_equals_the_library(bpe):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    alphabet = "aabcdeeisntr'thσΣßÀéİıǅ ǆ̣́ẛ̣ \t\n\x0b\x1c\x1d\x1e\x1f\x85\xa0​ 　﻿0١½Ⅷ一二ひñ👍🏽éͅ!?##$$..,--\x00\x7f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice(["<|startoftext|>", "<|endoftext|>", " a", "'s", "'S", "I'LL", " ", "x"]) for _ in range(rng.randint(0, 8))) for _ in range(500)]
    texts += ["".join(rng.choice("aaab") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a" * 20_000, "!" * 5000, "The quick brown fox isn't lazy."]
    got = list(itertools.chain.from_iterable(bpe.encode(texts[i : i + 100]) for i in range(0, len(texts), 100)))
    for text, (n, ids, decoded), want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert n == len(want.ids) and ids == np.array(want.ids, "<u4").tobytes() and decoded == library.decode(want.ids, skip_special_tokens=False), text[:80]
    assert 0 < bpe.failed < bpe.guessed


def test_bpe_compatibility_is_exact(bpe):
    """A pair passes the check just when merging its text gives the pair."""
    rng = np.random.default_rng(5)
    tokens = [t for t in range(49406) if not bpe.names[t].endswith("</w>")]
    ends = [t for t in range(49406) if bpe.names[t].endswith("</w>")]
    a, b = rng.choice(tokens, 3000), rng.choice(ends, 3000)
    ok = bpe.compatible(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), ok.tolist(), strict=True):
        assert (bpe.exact(bpe.names[x] + bpe.names[y].removesuffix("</w>")) == [x, y]) == good


def test_bpe_rows(spark):
    got = bpe_round_trip(frame(spark, ODD), WORDS).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.n_tokens for r in got}[1] == 0 and bpe_round_trip(frame(spark, []), WORDS).count() == 0


def brute_attribution(ends, bounds, rule):
    n, crossing = [0] * (len(bounds) - 1), [0] * (len(bounds) - 1)
    start = 0
    for end in ends:
        parts = [s for s in range(len(n)) if min(end, bounds[s + 1]) > max(start, bounds[s])]
        best = parts[0] if rule == "first" else parts[-1] if rule == "last" else max(parts, key=lambda s: (min(end, bounds[s + 1]) - max(start, bounds[s]), -s))
        n[best] += 1
        crossing[best] += len(parts) > 1
        start = end
    return n, crossing


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_attribution(rule):
    rng = random.Random(6)
    for text in ["", "a", "one. two. three", "ééé. é"] + ["".join(rng.choice(["ab", ". ", "\n", "é", " the", "?"]) for _ in range(40)) for _ in range(60)]:
        data = text.encode()
        for sep in (b"\n", b". ", b" "):
            ends, bounds = token_ends(data, RANKS), sections_of(data, sep)
            n, crossing = attribute(ends, bounds, rule)
            assert (n.tolist(), crossing.tolist()) == brute_attribution(ends.tolist(), bounds.tolist(), rule)
            assert n.sum() == len(encoding(RANKS).encode_ordinary(text))


def test_long_white_space(spark):
    """Runs that the library's matcher can take are cut as it does; longer ones are encoded too."""
    enc, rng = encoding(RANKS), random.Random(9)
    for _ in range(40):
        text = "".join(rng.choice(["a", " b", "'s", "7", "\n", "".join(rng.choice(" \n\t\u3000") for _ in range(rng.randint(9_990, 10_020))), " " * rng.randint(9_999, 12_000)]) for _ in range(5))
        assert encode(enc, text) == enc.encode_ordinary(text)
    assert not LONG_SPACE.search("\x1c" * 20_000) and LONG_SPACE.search("x" + "\xa0\u2003" * 5_000)
    docs = [(1, "a" + " " * 2_000_000 + "b"), (2, "\t" * 2_000_000), (3, "\n" * 2_000_000 + "x"), (4, "x")]
    got = {r.doc_id: r.n_tokens for r in pack(frame(spark, docs), RANKS).collect()}
    assert got[4] == 1 and got[1] > 2 and {r.doc_id: r.n_tokens for r in token_counts(frame(spark, docs[:2]), RANKS).collect()} == {i: got[i] for i in (1, 2)}


def test_token_counts(spark):
    docs = ODD + [(9, "One two.\nThree\n"), (10, "a\n\nb")]
    got = token_counts(frame(spark, docs), RANKS).collect()
    assert [(r.start, r.n_chars) for r in got if r.doc_id == 9] == [(0, 9), (9, 6)] and [r.n_chars for r in got if r.doc_id == 10] == [2, 1, 1]
    assert [r.n_tokens for r in got if r.doc_id == 1] == [0]
    for i in (6, 9, 10):
        assert sum(r.n_tokens for r in got if r.doc_id == i) == len(encoding(RANKS).encode_ordinary(dict(docs)[i]))
    assert any(r.n_crossing for r in token_counts(frame(spark, docs), RANKS, separator=" ").collect())
    assert token_counts(frame(spark, []), RANKS).count() == 0
    with pytest.raises(ValueError):
        token_counts(frame(spark, docs), RANKS, rule="none")


def test_optimal_bounds():
    """Against every choice of bounds."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        upper = np.unique(rng.integers(1, 60, 8))
        count = rng.integers(1, 9, len(upper))
        total = upper * count
        for buckets in (1, 2, 3):
            def padding(bounds):
                return sum((min(b for b in bounds if b >= u) - u) * n for u, n in zip(upper, count, strict=True))

            best = min(padding(c + (upper[-1],)) for k in range(buckets) for c in itertools.combinations(upper[:-1], k))
            got = optimal_bounds(upper, count, total, buckets)
            assert padding(got) == best and len(got) <= buckets and got[-1] == upper[-1]
    assert optimal_bounds(np.array([]), np.array([]), np.array([]), 4) == []


@pytest.mark.parametrize("shard_rows", [50_000, 7])
def test_packing(spark, shard_rows):
    docs = ODD + [(100 + i, "tok " * (i % 50)) for i in range(200)]
    rows = pack(frame(spark, docs), RANKS, buckets=5, token_budget=300, shard_rows=shard_rows).collect()
    assert len(rows) == len(docs) and len({r.bucket for r in rows}) <= 5
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_tokens
        batches[r.bucket, r.shard, r.batch].append(r)
    for part in batches.values():
        assert sorted(r.position for r in part) == list(range(len(part)))
        assert len(part) == 1 or len(part) * part[0].bucket_tokens <= 300
    assert pack(frame(spark, []), RANKS).count() == 0
