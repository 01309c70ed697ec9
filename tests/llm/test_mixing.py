import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from stayline.llm import mixing
from tests.llm.helpers import empty, odd_documents, table


def fill(budget, children):
    """children: name -> (weight, most). Exact water filling, whole tokens for those that are not full."""
    order = sorted(children, key=lambda n: (children[n][1] / children[n][0], n))
    out, weight = {}, sum(w for w, _ in children.values())
    for name in order:
        w, most = children[name]
        if budget > 0 and budget * w >= most * weight:
            out[name], budget, weight = most, budget - most, weight - w
        else:
            rest = {n: min(children[n][1], int(Fraction(max(budget, 0) * children[n][0], weight))) for n in order if n not in out}
            return out | rest
    return out


def budgets(leaves, mix):
    """leaves: path tuple -> tokens."""
    depth = len(next(iter(leaves)))
    total = sum(leaves.values())
    given = {(): min(mix.budget if mix.budget is not None else total * mix.share[0] // mix.share[1], total * mix.epochs)}
    for d in range(1, depth + 1):
        below = {}
        for parent, budget in given.items():
            names = {p[:d] for p in leaves if p[: d - 1] == parent}
            weighted = {"/".join(n): (mix.weights.get("/".join(n), mix.default_weight), mix.epochs * sum(t for p, t in leaves.items() if p[:d] == n)) for n in names}
            shared = fill(budget, {n: v for n, v in weighted.items() if v[0] > 0})
            below |= {n: shared["/".join(n)] for n in names if "/".join(n) in shared}
        given = below
    return given


def by_hand(docs, mix, leaf_of, tokens_of):
    leaves = {}
    for d in docs:
        leaves[leaf_of(d)] = leaves.get(leaf_of(d), 0) + tokens_of(d)
    given, out = budgets(leaves, mix), []
    for leaf, budget in given.items():
        own = [d for d in docs if leaf_of(d) == leaf]
        full, rest = divmod(budget, leaves[leaf]) if leaves[leaf] else (0, 0)

        def key(d):
            name = str(d[0]) if d[0] is not None else hashlib.md5(d[1].encode()).hexdigest() if d[1] is not None else ""
            return hashlib.md5(f"{mix.seed}:{full}:{name}".encode()).hexdigest()

        sums = {}
        for d in own:
            sums[key(d)] = sums.get(key(d), 0) + tokens_of(d)
        taken, last = 0, None
        for k in sorted(sums):
            if sums[k] and taken < rest:
                last, taken = k, taken + sums[k]
        out += [(d[0], budget, full + (last is not None and key(d) <= last)) for d in own]
    return sorted((r for r in out if r[2]), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def words(d):
    return len((d[1] or "").split())


def run(docs, mix):
    got = [tuple(r) for r in mixing.select(docs, mix).select("doc_id", "budget", "copies").collect()]
    return sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def test_odd_documents(spark):
    for share, weights in (((1, 2), {}), ((1, 1), {"en": 5, "en/src1": 1, "en/src2": 9, "es": 3}), ((3, 2), {"fr": 0}), ((9, 1), {})):
        mix = mixing.Mix(levels(), mixing.word_tokens(F.col("text")), share=share, weights=weights, epochs=3, seed=5)
        want = by_hand(odd_documents(), mix, lambda d: (d[2] or "unknown", d[3] or "unknown"), words)
        assert run(table(spark, clashing=("tokens", "rest", "key", "budget", "full", "_level0")), mix) == want


def test_shortages_go_to_siblings_before_ancestors():
    mix = mixing.Mix({"a": None, "b": None}, None, budget=100, weights={"x": 1, "y": 1, "x/p": 9}, epochs=1)
    leaves = {("x", "p"): 10, ("x", "q"): 60, ("y", "r"): 200}
    # x gets 50; p can use 10 of its 45, so q gets 40, and y's share stays 50
    assert budgets(leaves, mix) == {("x", "p"): 10, ("x", "q"): 40, ("y", "r"): 50}
    # with too little below x, the rest reaches y
    assert budgets({("x", "p"): 10, ("x", "q"): 20, ("y", "r"): 200}, mix) == {("x", "p"): 10, ("x", "q"): 20, ("y", "r"): 70}


def test_random_trees(spark):
    rng = random.Random(3)
    for _ in range(3):
        leaves = {(f"l{i}", f"s{j}"): rng.randrange(0, 5000) for i in range(3) for j in range(4)}
        weights = {"/".join(p): rng.randrange(0, 6) for p in leaves} | {f"l{i}": rng.randrange(1, 6) for i in range(3)}
        mix = mixing.Mix({"a": F.col("a"), "b": F.col("b")}, F.col("tokens"), budget=rng.randrange(1, 30_000), weights=weights, epochs=2)
        df = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "a string, b string, tokens bigint")
        got = {(r["a"], r["b"]): r["budget"] for r in mixing.leaf_budgets(df, mix).collect()}
        assert got == budgets(leaves, mix)


def test_names_that_hold_the_separator(spark):
    """Leaves whose levels give one text when joined are leaves of their own, with weights of their own by tuples."""
    names = ["a", "b", "c", "a/b", "b/c", "a/b/c", "/", "", "//"]
    rng = random.Random(8)
    for weights in ({}, {("a/b", "c"): 7, ("a", "b/c"): 1, ("a",): 3, "b/c": 5, ("/",): 0}):
        docs = [(i, "w " * rng.randrange(1, 40), rng.choice(names), rng.choice(names)) for i in range(150)]
        docs += [(500, "w w w", "a/b", "c"), (501, "w w w", "a", "b/c")]
        by_tuple = {tuple(k.split("/")) if isinstance(k, str) else k: v for k, v in weights.items()}
        # levels without slashes one by one stand for those with them, in the same order
        plain = {n: f"{i:02d}" for i, n in enumerate(sorted(names))}
        named = [(d, t, plain[a], plain[b]) for d, t, a, b in docs]
        own = {"/".join(plain[x] for x in k): v for k, v in by_tuple.items()}
        args = {"share": (1, 3), "epochs": 2, "seed": 4}
        want = by_hand(named, mixing.Mix(levels(), None, weights=own, **args), lambda d: (d[2], d[3]), words)
        got = run(table(spark, docs), mixing.Mix(levels(), mixing.word_tokens(F.col("text")), weights=weights, **args))
        assert got == want and len({r[0] for r in got}) == len(got)


def test_long_leaf_is_cut_by_cells(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "src0") for i in range(6000)]
    mix = mixing.Mix(levels(), mixing.word_tokens(F.col("text")), share=(2, 5), epochs=1, seed=1)
    assert run(table(spark, rows), mix) == by_hand(rows, mix, lambda d: (d[2], d[3]), words)


def test_empty_table(spark):
    assert run(empty(spark), mixing.Mix(levels(), mixing.word_tokens(F.col("text")))) == []
