"""A rule language compiled to Catalyst: conditions become Columns, a rule list becomes a fold of struct columns."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnsafeExpression(ValueError):
    """The expression uses something outside the language."""


def _floor_mod(a: Column, b: Column) -> Column:
    return a - F.floor(a / b) * b


BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a.cast("double") / b,
    ast.Pow: lambda a, b: F.pow(a, b),
    ast.Mod: _floor_mod,
    ast.FloorDiv: lambda a, b: F.floor(a / b),
}
COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}
CALLS = {
    "abs": F.abs,
    "min": F.least,
    "max": F.greatest,
    "round": lambda x, n=None: F.rint(x) if n is None else F.bround(x, n),
    "len": F.length,
    "sqrt": F.sqrt,
    "log": F.ln,
    "int": lambda x: x.cast("long"),
    "float": lambda x: x.cast("double"),
}


def names(expression: str) -> set[str]:
    return {n.id for n in ast.walk(ast.parse(expression, mode="eval")) if isinstance(n, ast.Name)} - set(CALLS)


def compile_expression(expression: str, env: Mapping[str, Column]) -> Column:
    """The Column of an expression over named columns. Raises UnsafeExpression, or KeyError for an undefined name."""

    def test(n: ast.AST):
        """Numbers and texts count as true unless they are 0 or empty."""
        boolean = isinstance(n, (ast.Compare, ast.BoolOp)) or (isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not)) or (isinstance(n, ast.Constant) and isinstance(n.value, bool))
        if boolean:
            return go(n)
        if isinstance(n, (ast.BinOp, ast.UnaryOp, ast.Call, ast.Constant)) and not (isinstance(n, ast.Constant) and isinstance(n.value, str)):
            return go(n).cast("double") != 0
        text = go(n).cast("string")  # of a name the type isn't known here
        return F.coalesce(~text.isin("", "false"), F.lit(False)) & F.coalesce(text.try_cast("double") != 0, F.lit(True))

    def go(n: ast.AST):
        match n:
            case ast.Expression(body=b):
                return go(b)
            case ast.Constant(value=v) if v is None or isinstance(v, (bool, int, float, str)):
                return F.lit(v)
            case ast.Name(id=i):
                return env[i]
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~test(x)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -go(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return go(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
                return BINARY[type(op)](go(a), go(b))
            case ast.BoolOp(op=op, values=vs):
                out = test(vs[0])
                for v in vs[1:]:
                    out = out & test(v) if isinstance(op, ast.And) else out | test(v)
                return out
            case ast.Compare(left=a, ops=ops, comparators=bs):
                out, left = None, a
                for op, b in zip(ops, bs):
                    if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.List, ast.Tuple)):
                        x = go(left)
                        one = F.lit(False)
                        for e in b.elts:
                            one = one | (x == go(e))
                        one = ~one if isinstance(op, ast.NotIn) else one
                    elif isinstance(op, (ast.In, ast.NotIn)):
                        one = F.contains(go(b), go(left))
                        one = ~one if isinstance(op, ast.NotIn) else one
                    elif type(op) in COMPARE:
                        one = COMPARE[type(op)](go(left), go(b))
                    else:
                        raise UnsafeExpression(ast.dump(op))
                    out, left = one if out is None else out & one, b
                return out
            case ast.IfExp(test=t, body=b, orelse=o):
                return F.when(test(t), go(b)).otherwise(go(o))
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in CALLS:
                if f == "round" and len(args) == 2 and isinstance(args[1], ast.Constant):
                    return CALLS[f](go(args[0]), args[1].value)
                return CALLS[f](*map(go, args))
        raise UnsafeExpression(ast.dump(n))

    return go(ast.parse(expression, mode="eval"))


#: Names that rules may use besides the columns: values for all rows.
LIMITS = {"scale_max": 10.0, "min_words": 300.0, "max_words": 1500.0}


def truthy(c: Column, kind: str) -> Column:
    """Whether a value of a Spark type counts as true: not null, not 0, not empty."""
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    return F.coalesce(c.cast("double") != 0, F.lit(False))


def _kind(df: DataFrame, c: Column) -> str:
    """The type of an expression, from the analysed plan: nothing runs."""
    return df.select(c.alias("c")).dtypes[0][1]


def weighted_total(scores: Mapping[str, Column], criteria: Mapping[str, tuple[float, float]], scale: float = 10.0) -> Column:
    """The total of criterion scores by criteria (name: maximum, weight). Null scores count as 0."""
    return sum((F.coalesce(scores[c], F.lit(0.0)) / top * weight * scale for c, (top, weight) in criteria.items()), F.lit(0.0))


def apply_rules(df: DataFrame, rules: list[dict], total: str = "total", scale: float = 10.0, criteria: Mapping[str, tuple[float, float]] | None = None, limits: Mapping[str, float] | None = None, strict: bool = False) -> DataFrame:
    """df with final_total, flags, applied_rules, skipped_rules, needs_review and review_reason, rules taken in order.

    Actions: cap_total, subtract (not below 0), set_total, set_criterion (of the rule's target; the total is then computed
    anew from criteria (name: maximum, weight), which takes back earlier caps), review and flag; an unknown one is noted
    as a reason. stop ends the list for a row. A rule whose condition names something undefined or unsafe is skipped, or
    fails the call if strict; a bad value always fails it. A rule without a condition never holds. Conditions see the
    total as it stands and the criteria as they came. Only subtract bounds the total here; a null total stays null.
    """
    criteria = criteria or {}
    env = {k: F.lit(float(v)) for k, v in (LIMITS | {"scale_max": scale} | dict(limits or {})).items()} | {c: F.col(c) for c in df.columns}
    scores = {k: F.col(k) for k in criteria}
    empty = F.array().cast("array<string>")
    state = df.withColumns({"_total": F.col(total).cast("double"), "_stop": F.lit(False), "_review": F.lit(False), "_flags": empty, "_applied": empty, "_reasons": empty, **{f"_c_{k}": c.cast("double") for k, c in scores.items()}})
    skipped = []
    known = env | {"total": F.col("_total")}
    for i, r in enumerate(rules):
        rid, condition = r.get("id", f"rule_{i + 1}"), str(r.get("when") or "").strip()
        if not condition:
            continue
        try:
            found = compile_expression(condition, known)
            hit = truthy(found, _kind(state, found)) & ~F.col("_stop")
        except (UnsafeExpression, KeyError, SyntaxError) as e:
            if strict:
                raise UnsafeExpression(f"{rid}: {e}") from e
            skipped.append(f"{rid}: {e.args[0]} is not defined" if isinstance(e, KeyError) else f"{rid}: not allowed")
            continue
        value = compile_expression(str(r["value_expr"]), known).cast("double") if "value_expr" in r else F.lit(r.get("value")).cast("double")
        new, change, said = F.col("_total"), {}, None
        match r.get("action", "flag"):
            case "cap_total":
                new = F.when(new.isNotNull(), F.least(new, value))
            case "subtract":
                new = F.when(new.isNotNull(), F.greatest(F.lit(0.0), new - value))
            case "set_total":
                new = value
            case "set_criterion":
                k = r.get("target", r.get("criterion"))
                if k in criteria:
                    change[f"_c_{k}"] = F.when(hit, value).otherwise(F.col(f"_c_{k}"))
                new = weighted_total({c: value if c == k else F.col(f"_c_{c}") for c in criteria}, criteria, scale)
            case "review":
                change["_review"] = F.col("_review") | hit
                said = r.get("reason")
            case "flag":
                pass
            case other:
                said = f"[{rid}] unknown action: {other}"
        change |= {"_total": F.when(hit, new).otherwise(F.col("_total")), "_applied": F.when(hit, F.concat("_applied", F.array(F.lit(rid)))).otherwise(F.col("_applied"))}
        if said:
            change["_reasons"] = F.when(hit, F.concat("_reasons", F.array(F.lit(str(said))))).otherwise(F.col("_reasons"))
        if r.get("flag"):
            change["_flags"] = F.when(hit, F.concat("_flags", F.array(F.lit(str(r["flag"]))))).otherwise(F.col("_flags"))
        if r.get("stop"):
            change["_stop"] = F.col("_stop") | hit
        state = state.withColumns(change)
    notes = F.concat(F.array(*map(F.lit, skipped)) if skipped else empty, "_reasons")
    return state.select(
        *df.columns,
        F.col("_total").alias("final_total"),
        F.array_join(F.array_sort(F.array_distinct("_flags")), "|").alias("flags"),
        F.array_join("_applied", "|").alias("applied_rules"),
        F.lit("; ".join(skipped)).alias("skipped_rules"),
        F.col("_review").alias("needs_review"),
        F.when(F.col("_review"), F.array_join(F.array_distinct(notes), "; ")).otherwise("").alias("review_reason"),
    )


# What conditions of shipped rule lists may name besides columns and criteria.
FEATURES = (
    "n_words", "sim_prompt", "dup_ratio", "prompt_copy_ratio", "spell_error_rate", "confidence", "total", "scale_max", "min_words",
    "max_words", "keyword_coverage", "n_paragraphs", "snap_gap", "max_snap_gap", "pred_std", "teencode_rate", "informal_rate",
    "diacritic_ratio", "ai_style_score", "cliche_density", "has_citation", "mean_sentence_len", "ttr", "structure_score",
    "connective_density", "sim_reference", "sim_centroid",
)


def check_rules(rules: list[dict], columns: list[str] | tuple[str, ...] = FEATURES, criteria: set[str] = frozenset()) -> list[str]:
    """Problems that can be seen without data: syntax, what isn't allowed, names, actions, targets."""
    known, actions = {*columns, *criteria, *LIMITS, "total"}, {"cap_total", "subtract", "set_total", "set_criterion", "review", "flag"}
    out = []
    for i, r in enumerate(rules):
        rid = r.get("id", f"rule_{i + 1}")
        for e in filter(None, (r.get("when"), r.get("value_expr"))):
            try:
                unknown = sorted(names(str(e)) - known)
                out += [f"{rid}: {n} is not defined" for n in unknown]
                if not unknown:
                    compile_expression(str(e), {n: F.lit(1.0) for n in names(str(e))})
            except SyntaxError:
                out.append(f"{rid}: syntax error in {e!r}")
            except UnsafeExpression:
                out.append(f"{rid}: not allowed in {e!r}")
        if r.get("action", "flag") not in actions:
            out.append(f"{rid}: unknown action {r.get('action')}")
        if r.get("action") == "set_criterion" and r.get("target", r.get("criterion")) not in criteria:
            out.append(f"{rid}: unknown criterion {r.get('target', r.get('criterion'))}")
    return out
