"""Evidence scores as columns, with the SQL text of the same formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import text as fx


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _when(*cases: tuple[Column, object], other: object = 0.0) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(other)


def indicators(c: Column, patterns) -> Column:
    """For each pattern that matches at all: its match and groups."""
    return reduce(lambda a, b: a + b, [F.when(fx.matches(c, p), n).otherwise(0) for p, n in patterns])


def indicators_sql(c: str, patterns) -> str:
    return "(" + " + ".join(f"case when {fx.matches_sql(c, p)} then {n} else 0 end" for p, n in patterns) + ")"


# Content. Input columns: text, n_words, n_sentences, whole_start, whole_end.


def content_metrics(t: Column) -> dict[str, Column]:
    return {
        "unique_ratio": fx.let(fx.word_list(t), lambda w: F.coalesce(F.try_divide(F.size(F.array_distinct(F.transform(w, F.lower))), F.size(w)), F.lit(0.0))),
        "punct_ratio": F.coalesce(F.try_divide(F.regexp_count(t, F.lit(r"[^A-Za-z0-9_\t\n\r ]")), F.length(t)), F.lit(0.0)),
        "specific": indicators(t, P.SPECIFIC), "vague": indicators(t, P.VAGUE), "formal": indicators(t, P.FORMAL), "structural": indicators(t, P.STRUCTURE),
        "fillers": fx.count(t, P.FILLER), "facts": fx.count(t, P.FACT), "transitions": fx.count(t, P.TRANSITION), "past": fx.count(t, P.PAST), "present": fx.count(t, P.PRESENT), "contrasts": fx.count(t, P.CONTRAST),
    }


def content_metrics_sql(t: str) -> str:
    ws = fx.word_list_sql(t)
    parts = {
        "unique_ratio": f"coalesce(len(list_distinct(list_transform({ws}, lambda x: lower(x))))::double / nullif(len({ws}), 0), 0.0)",
        "punct_ratio": f"coalesce(len(regexp_extract_all({t}, '[^A-Za-z0-9_\\t\\n\\r ]'))::double / nullif(length({t}), 0), 0.0)",
        "specific": indicators_sql(t, P.SPECIFIC), "vague": indicators_sql(t, P.VAGUE), "formal": indicators_sql(t, P.FORMAL), "structural": indicators_sql(t, P.STRUCTURE),
        "fillers": fx.count_sql(t, P.FILLER), "facts": fx.count_sql(t, P.FACT), "transitions": fx.count_sql(t, P.TRANSITION), "past": fx.count_sql(t, P.PAST), "present": fx.count_sql(t, P.PRESENT), "contrasts": fx.count_sql(t, P.CONTRAST),
    }
    return ", ".join(f"{v} as {k}" for k, v in parts.items())


def content_components() -> dict[str, Column]:
    c = F.col
    w, s = c("n_words"), c("n_sentences")
    per = F.coalesce(F.try_divide(w.cast("double"), s), F.lit(0.0))
    both, one = c("whole_start") & c("whole_end"), c("whole_start") | c("whole_end")
    ratio = c("specific") / F.greatest(F.lit(1.0), w / F.lit(10.0))
    verbs = c("past") + c("present")
    return {
        "specificity": clamp(0.5 + F.least(F.lit(0.4), c("specific") * 0.1) - F.least(F.lit(0.3), c("vague") * 0.05) + F.least(F.lit(0.15), c("formal") * 0.05)),
        "completeness": clamp(0.5 + _when((both, 0.2), (one, 0.1)) + _when((per.between(8, 25), 0.15), (per < 5, -0.1), (per > 30, -0.1)) + _when((c("punct_ratio").between(0.05, 0.25), 0.1), (c("punct_ratio") > 0.25, -0.15))),
        "readability": clamp(
            0.5 + _when((w.between(15, 100), F.lit(0.2)), (w < 15, -F.least(F.lit(0.3), (15 - w) * 0.02)), other=-F.least(F.lit(0.2), (w - 100) * 0.01))
            + F.least(F.lit(0.15), c("structural") * 0.05) + F.when(c("unique_ratio") >= 0.6, 0.15).otherwise(-0.3 * (0.6 - c("unique_ratio")))
        ),
        "density": clamp(0.5 + _when((ratio >= 0.5, 0.3), (ratio >= 0.2, 0.15)) - F.when(c("fillers") > w * 0.1, F.least(F.lit(0.2), c("fillers") * 0.02)).otherwise(0.0) + F.least(F.lit(0.2), c("facts") * 0.05)),
        "coherence": clamp(
            0.5 + F.least(F.lit(0.2), c("transitions") * 0.1) + F.when(F.try_divide(F.greatest("past", "present").cast("double"), verbs) >= 0.7, 0.15).otherwise(0.0)
            - F.when(c("contrasts") > s * 0.5, 0.1).otherwise(0.0)
        ),
    }


CONTENT_SQL = {
    "specificity": "0.5 + least(0.4, specific * 0.1) - least(0.3, vague * 0.05) + least(0.15, formal * 0.05)",
    "completeness": """0.5 + case when whole_start and whole_end then 0.2 when whole_start or whole_end then 0.1 else 0 end
      + case when per between 8 and 25 then 0.15 when per < 5 then -0.1 when per > 30 then -0.1 else 0 end + case when punct_ratio between 0.05 and 0.25 then 0.1 when punct_ratio > 0.25 then -0.15 else 0 end""",
    "readability": """0.5 + case when n_words between 15 and 100 then 0.2 when n_words < 15 then -least(0.3, (15 - n_words) * 0.02) else -least(0.2, (n_words - 100) * 0.01) end
      + least(0.15, structural * 0.05) + case when unique_ratio >= 0.6 then 0.15 else -0.3 * (0.6 - unique_ratio) end""",
    "density": """0.5 + case when specific::double / greatest(1.0, n_words / 10.0) >= 0.5 then 0.3 when specific::double / greatest(1.0, n_words / 10.0) >= 0.2 then 0.15 else 0 end
      - case when fillers > n_words * 0.1 then least(0.2, fillers * 0.02) else 0 end + least(0.2, facts * 0.05)""",
    "coherence": """0.5 + least(0.2, transitions * 0.1) + case when greatest(past, present)::double / nullif(past + present, 0) >= 0.7 then 0.15 else 0 end - case when contrasts > n_sentences * 0.5 then 0.1 else 0 end""",
}


def content_score(parts: dict[str, Column]) -> Column:
    return clamp(reduce(lambda a, b: a + b, [parts[k] * w for k, w in P.CONTENT_WEIGHTS.items()]))


# Authority. Input columns: tier, domain, title, metadata (JSON).


def authority() -> Column:
    d, t = F.col("domain"), F.col("title")
    tier = _when(*[(F.col("tier") == k, v) for k, v in P.TIERS.items()], other=0.4)
    best = F.greatest(F.when(fx.matches(d, P.ACADEMIC), 0.15).otherwise(0.0), F.when(fx.matches(d, P.GOVERNMENT), 0.12).otherwise(0.0), F.when(fx.matches(d, P.NONPROFIT), 0.08).otherwise(0.0))
    boost = F.when(fx.matches(d, P.SOCIAL), -0.1).otherwise(best)
    titled = reduce(lambda a, b: a + b, [F.when(fx.matches(t, p), v).otherwise(0.0) for p, v in P.TITLE_BOOSTS])
    has = lambda *ks: reduce(lambda a, b: a | b, [F.get_json_object("metadata", f"$.{k}").isNotNull() for k in ks])
    meta = F.when(has("peerReviewed", "reviewed"), 0.08).otherwise(0.0) + F.when(has("doi", "isbn", "pmid"), 0.03).otherwise(0.0)
    return clamp(tier + boost + titled + meta)


def authority_sql() -> str:
    tier = "case tier " + " ".join(f"when '{k}' then {v}" for k, v in P.TIERS.items()) + " else 0.4 end"
    m = lambda c, p: fx.matches_sql(c, p)
    boost = f"case when {m('domain', P.SOCIAL)} then -0.1 when {m('domain', P.ACADEMIC)} then 0.15 when {m('domain', P.GOVERNMENT)} then 0.12 when {m('domain', P.NONPROFIT)} then 0.08 else 0 end"
    titled = " + ".join(f"case when {m('title', p)} then {v} else 0 end" for p, v in P.TITLE_BOOSTS)
    key = lambda k: f"case when json_valid(metadata) then metadata ->> '$.{k}' end is not null"
    meta = f"case when {key('peerReviewed')} or {key('reviewed')} then 0.08 else 0 end + case when {key('doi')} or {key('isbn')} or {key('pmid')} then 0.03 else 0 end"
    return f"least(1.0, greatest(0.0, {tier} + {boost} + {titled} + {meta}))::double"


# Recency. Input columns: title, text, url, age (days).


def recency_counts() -> dict[str, Column]:
    """The indicators that recency() needs, each counted once; to be selected before it."""
    all_ = F.concat_ws(" ", F.coalesce("title", F.lit("")), "text", F.coalesce("url", F.lit("")))
    t = F.col("text")
    return {
        **{f"n_{k}": indicators(all_, p) for k, p in P.CONTENT_TYPES.items()},
        "n_fresh": indicators(t, P.FRESH), "n_timeless": indicators(t, P.TIMELESS), "n_factual": indicators(t, P.FACTUAL), "n_opinion": indicators(t, P.OPINION),
    }


def recency() -> dict[str, Column]:
    """kind, decay (from kind) and score (from decay), from recency_counts() and age."""
    age = F.col("age")
    n = {k: F.col(f"n_{k}") for k in P.CONTENT_TYPES}
    top = F.greatest(*n.values())
    kind = _when((top == 0, F.lit("reference")), *[(n[k] == top, F.lit(k)) for k in n], other=F.lit("reference"))
    decay = F.lit(0.0)
    for k, (half, most, base) in P.DECAY.items():
        decay = F.when((F.col("kind") == k) & (age < most), F.lit(base) * F.pow(F.lit(0.5), age / F.lit(float(half)))).otherwise(decay)
    fresh = (F.col("n_fresh") > 0) & (age > 7)
    after = F.when(fresh, F.greatest(F.lit(0.0), F.col("decay") - F.least(F.lit(0.4), (age - 7) * 0.02))).otherwise(F.col("decay"))
    score = clamp(after + F.when(F.col("n_timeless") > 0, 0.3 * (1 - F.col("decay"))).otherwise(0.0) + F.when(F.col("n_factual") > F.col("n_opinion"), 0.15 * (1 - F.col("decay"))).otherwise(0.0))
    return {"kind": kind, "decay": decay, "score": score}


def recency_sql(rows: str) -> str:
    """SELECT over rows (id, title, text, url, age) giving id, kind, score."""
    all_ = "(coalesce(title, '') || ' ' || text || ' ' || coalesce(url, ''))"
    counts = ", ".join(f"{indicators_sql(all_, p)} as n_{k}" for k, p in P.CONTENT_TYPES.items())
    top = "greatest(" + ", ".join(f"n_{k}" for k in P.CONTENT_TYPES) + ")"
    kind = f"case when {top} = 0 then 'reference' " + " ".join(f"when n_{k} = {top} then '{k}'" for k in P.CONTENT_TYPES) + " end"
    decay = "case " + " ".join(f"when kind = '{k}' and age < {most} then {base} * pow(0.5::double, age / {half}.0::double)" for k, (half, most, base) in P.DECAY.items()) + " else 0.0 end"
    return f"""select id, kind, least(1.0, greatest(0.0, case when {indicators_sql('text', P.FRESH)} > 0 and age > 7 then greatest(0.0, decay - least(0.4, (age - 7) * 0.02)) else decay end
      + case when {indicators_sql('text', P.TIMELESS)} > 0 then 0.3 * (1 - decay) else 0 end + case when {indicators_sql('text', P.FACTUAL)} > {indicators_sql('text', P.OPINION)} then 0.15 * (1 - decay) else 0 end)) as score
      from (select *, {decay} as decay from (select *, {kind} as kind from (select *, {counts} from ({rows}))))"""


# Relevance. Input column: text.


def relevance(topics: list[str], fields: list[str], keywords: list[str]) -> Column:
    t = F.col("text")
    low = F.lower(t)
    hits = lambda ks, ps: reduce(lambda a, b: a + b, [F.contains(low, F.lit(k.lower())).cast("int") for k in ks] + [fx.matches(low, p).cast("int") for p in ps])
    direct = F.lit(0.0)
    for k in topics:
        weight, ks, ps = P.TOPICS[k]
        direct = direct + hits(ks, ps) * (weight * 0.1)
    for k in fields:
        weight, ks, ps = P.FIELDS[k]
        direct = direct + hits(ks, ps) * (weight * 0.15)
    for k in keywords:
        direct = direct + F.contains(low, F.lit(k.lower())).cast("int") * 0.1
    context = F.greatest(*[F.when(reduce(lambda a, b: a | b, [fx.matches(t, p) for p in ps]), v).otherwise(0.0) for v, ps in P.CONTEXTS.values()])
    terms = reduce(lambda a, b: a + b, [fx.count(t, p) for p in P.TERMS])
    ratio = F.coalesce(F.try_divide(terms.cast("double"), F.size(F.split(t, fx.WS + "+", -1))), F.lit(0.0))
    special = _when((ratio > 0.1, 0.9), (ratio > 0.05, 0.7), (ratio > 0.02, 0.5), other=0.3)
    return clamp(F.least(F.lit(1.0), direct) * 0.4 + 0.5 * 0.3 + F.when(context == 0, 0.3).otherwise(context) * 0.2 + special * 0.1)


def relevance_sql(topics: list[str], fields: list[str], keywords: list[str]) -> str:
    low = "lower(text)"
    hits = lambda ks, ps: "(" + " + ".join([f"contains({low}, '{k.lower()}')::int" for k in ks] + [fx.matches_sql(low, p) + "::int" for p in ps]) + ")"
    parts = [f"{hits(*P.TOPICS[k][1:])} * {P.TOPICS[k][0]} * 0.1" for k in topics] + [f"{hits(*P.FIELDS[k][1:])} * {P.FIELDS[k][0]} * 0.15" for k in fields] + [f"contains({low}, '{k.lower()}')::int * 0.1" for k in keywords]
    context = "greatest(" + ", ".join("case when " + " or ".join(fx.matches_sql("text", p) for p in ps) + f" then {v} else 0 end" for v, ps in P.CONTEXTS.values()) + ")"
    terms = " + ".join(fx.count_sql("text", p) for p in P.TERMS)
    ratio = f"(({terms})::double / len(string_split_regex(text, '{fx.WS}+')))"
    special = f"case when {ratio} > 0.1 then 0.9 when {ratio} > 0.05 then 0.7 when {ratio} > 0.02 then 0.5 else 0.3 end"
    return f"least(1.0, greatest(0.0, least(1.0, {' + '.join(parts)}) * 0.4 + 0.15 + case when {context} = 0 then 0.3 else {context} end * 0.2 + {special} * 0.1))::double"
