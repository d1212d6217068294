import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyweave.llm import quality_rules as R

from .helpers import odd_docs, prose


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_measures_match_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice(["a ", "b ", "c\t", "\n", "é ", "#", "| ", "x y z ", "\x0b", "  "]) for _ in range(rng.randint(0, 120)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "\n\n"), (903, "same words " * 3000), (None, "a"), (3, "a a a a a a a a a")]
    rows = R.measures(odd_docs(spark, docs), keep=("doc_id",)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((i is None, i or 0, *brute(t)) for i, t in docs)


def binomial(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_bounds_are_exact(spark):
    cases = [(k, n) for n in (0, 1, 50, 300, 900) for k in (0, 1, 3, 8, 20) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", R.certified(F.col("k"), F.col("n"), 0.02, 0.01).alias("ok"))
    for r in df.collect():
        assert r.ok == (r.n > 0 and r.k < r.n * 0.02 and binomial(r.k, r.n, 0.02) <= 0.01), r


def test_large_holdouts_do_not_underflow(spark):
    df = spark.createDataFrame([(100, 1_000_000), (19_400, 1_000_000), (19_990, 1_000_000)], "k long, n long").select(R.certified(F.col("k"), F.col("n"), 0.02, 0.001).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, True, False]


def plain(t):
    """The measures of a text, in plain Python."""
    words, chars, symbols, dup, repeated = brute(t)
    n, w = max(words, 1), re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "symbol_ratio": symbols / n, "upper_ratio": sum("A" <= c <= "Z" for c in t or "") / max(chars, 1), "dup_line_ratio": dup / max(len(lines), 1),
        "repeat_ratio": repeated / n, "same_word_ratio": 1 - len(set(w)) / n if words < 100 else 0.0, "bang_ratio": (t or "").count("!") / n,
    }


def test_cutoffs_match_a_plain_search(spark):
    rng, spec = random.Random(5), R.RiskSpec(strata=("en", "fr"))
    docs, labels = [], []
    for i in range(900):
        w = prose(rng, 40).split()
        junk = i % 4 == 0
        docs.append((i, " ".join(x + ("$" if rng.random() < (0.9 if junk else 0.02) else "") + ("!" if junk and rng.random() < 0.4 else "") for x in w)))
        labels.append((i, int(not junk)))
    rows = odd_docs(spark, docs)
    out = R.quality_rules(rows, spark.createDataFrame(labels, "doc_id long, quality int"), spec).collect()
    steps, table, good = R.path(), {i: plain(t) for i, t in docs}, dict(labels)
    hits = {i: [j for j, (m, c) in enumerate(steps) if table[i][m] > c] for i, _ in docs}
    total, rule = sum(good.values()), {}
    for lang, parity in (("en", 1), ("fr", 0)):
        ids = [i for i, _ in docs if i % 2 == parity]
        useful = sorted({min(hits[i]) for i in ids if not good[i] and hits[i]})
        n = sum(good[i] for i in ids)
        rule[lang] = []
        for at, t in enumerate(useful):
            k = sum(good[i] and any(j in useful[: at + 1] for j in hits[i]) for i in ids)
            if not (k < n * spec.alpha and binomial(k, n, spec.alpha) <= spec.delta * n / total):
                break
            rule[lang].append(t)
    assert any(rule.values())
    for r in out:
        lang = "en" if r.doc_id % 2 else "fr"
        assert r.kept == (not r.base_failed and not any(table[r.doc_id][m] > c for m, c in (steps[j] for j in rule[lang]))), r


def test_the_joint_false_rejection_stays_under_alpha(spark):
    """Many strata at once, each a holdout drawn anew: the rule's true joint rate passes alpha in few of them."""
    strata, n, alpha = [f"s{i}" for i in range(150)], 300, 0.05
    spec = R.RiskSpec(alpha=alpha, delta=0.1 * len(strata), strata=tuple(strata))
    # independent exponential measures of good rows, so the joint rate of cutoffs is known
    names, scale = sorted(R.GRIDS), 0.12
    rng = random.Random(9)
    rows = [(s, 1, *(rng.expovariate(1 / scale) for _ in names)) for s in strata for _ in range(n)]
    rows += [(s, 0, *(rng.random() for _ in names)) for s in strata for _ in range(150)]
    holdout = spark.createDataFrame(rows, "stratum string, quality int, " + ", ".join(f"{m} double" for m in names))
    cutoffs = {}
    for s, m, c in R.choose_cutoffs(holdout, spec):
        cutoffs.setdefault(s, {})[m] = c
    rate = [1 - math.prod(1 - math.exp(-c / scale) for c in cutoffs.get(s, {}).values()) for s in strata]
    assert sum(bool(c) for c in cutoffs.values()) > 100
    assert sum(r > alpha for r in rate) <= 0.1 * len(strata) + 10  # three standard deviations more


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        junk = i % 5 == 0
        t = prose(rng, 30)
        docs.append((i, t.replace(" ", "$$$ ") if junk else t))
        labels.append((i, int(not junk)))
    spec = R.RiskSpec(strata=("en", "fr"))
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in R.quality_rules(odd_docs(spark, docs), known, spec).collect()}
    clean = [out[i].kept for i, y in labels if y]
    assert sum(clean) / len(clean) > 0.98
    assert not any(out[i].kept for i, y in labels if not y)


def test_without_labels_only_the_base_rule_rejects(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = R.quality_rules(odd_docs(spark, [(1, "word$$$ " * 30), (2, "a"), (None, None)]), none).collect()
    assert all(r.kept == (not r.base_failed) for r in rows) and len(rows) == 3
    assert R.quality_rules(odd_docs(spark, []), none).collect() == []


def test_no_python_in_the_plan(spark):
    plan = R.measures(odd_docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
