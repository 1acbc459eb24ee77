"""Closure of quads under an OWL-RL subset, by semi-naive iteration.

Each round joins only the statements that the last one added with all that are known. Each round's new statements are a table of their
own in the shared folder, bucketed by the hash of the statement; what is known is the union of these tables and is never written or moved
again: only candidates are, to where a statement of their hash would lie. Every inferred statement carries the rule and the premises that
gave it first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semforge.functions.iri import OWL, RDFS, TYPE
from semforge.sources.snapshots import digest_of
from semforge.storage import bucketed, cut_lineage, spread

ROUNDS = 256
RULE_SET = "owl-rl-subset-1"
_KEY = ("subject", "predicate", "object_kind", "object")
#: Pairs up to this number are closed on the driver, as those of a schema are; more are closed by joins.
FEW_PAIRS, FEW_PATHS = 20_000, 200_000


def _closed_here(rows: list) -> set | None:
    """All paths over the pairs, or None if there are too many of them."""
    steps: dict = {}
    for a, b in rows:
        steps.setdefault(a, set()).add(b)
    found = set()
    for start in steps:
        todo, seen = list(steps[start]), set(steps[start])
        while todo:
            for x in steps.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        found |= {(start, x) for x in seen}
        if len(found) > FEW_PATHS:
            return None
    return found


def transitive(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """All (a, b) with a path from a to b. A few pairs are closed at once; many by doubling: each round joins paths with paths."""
    few = pairs.select("a", "b").limit(FEW_PAIRS + 1).collect()
    if len(few) <= FEW_PAIRS and (paths := _closed_here([(r.a, r.b) for r in few])) is not None:
        return pairs.sparkSession.createDataFrame(list(paths), pairs.select("a", "b").schema)
    known = cut_lineage(pairs.select("a", "b").distinct())
    for _ in range(rounds):
        longer = known.alias("l").join(known.alias("r"), F.col("l.b") == F.col("r.a")).select(F.col("l.a").alias("a"), F.col("r.b").alias("b")).distinct()
        new = cut_lineage(longer.join(known, ["a", "b"], "left_anti"))
        if not new.limit(1).count():
            return known
        known = cut_lineage(known.union(new))
    raise RuntimeError(f"no fixed point in {rounds} rounds")


_SYMMETRIC, _TRANSITIVE = f"{OWL}SymmetricProperty", f"{OWL}TransitiveProperty"
#: Schema predicates: what of them makes a rule of which kind, and which also hold the other way round.
_KINDS = {f"{RDFS}subClassOf": "class", f"{OWL}equivalentClass": "class", f"{RDFS}subPropertyOf": "property", f"{OWL}equivalentProperty": "property", f"{RDFS}domain": "domain", f"{RDFS}range": "range", f"{OWL}inverseOf": "inverse"}
_BOTH = (f"{OWL}equivalentClass", f"{OWL}equivalentProperty", f"{OWL}inverseOf")
_STATEMENT = (*_KEY, "datatype", "language")
_DERIVED = (*_STATEMENT, "id", "rule", "premises")


def statement_id() -> Column:
    """The hash of a statement, whatever graph it is in."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in _STATEMENT]), 256)


def _is_schema() -> Column:
    return (F.col("predicate").isin(*_KINDS) | ((F.col("predicate") == TYPE) & F.col("object").isin(_SYMMETRIC, _TRANSITIVE))) & (F.col("object_kind") == "iri")


@dataclass(frozen=True)
class _Rules:
    """Rules as rows (kind, a, b, axiom); whether one about a predicate can give a class, and whether one chains statements."""

    rows: DataFrame
    typing: bool
    chains: bool


@dataclass(frozen=True)
class Closed:
    """A closure as it lies in buckets of ids: what was given, what the rounds added, and the number of the last."""

    given: DataFrame
    found: Sequence[DataFrame] = field(default_factory=list)
    rounds: int = 0

    @property
    def inferred(self) -> DataFrame:
        return _as_inferred(list(self.found), self.given)


def _gives_class() -> Column:
    """A rule about a predicate can only give a class if it is of these."""
    return F.col("kind").isin("domain", "range") | (F.col("kind").isin("property", "inverse", "symmetric") & (F.coalesce("b", "a") == TYPE))


def _kept_rules(known: DataFrame) -> _Rules:
    rows = cut_lineage(_rules(known), "rules")
    has = rows.agg(F.count_if(_gives_class()).alias("typing"), F.count_if(F.col("kind") == "transitive").alias("chains")).first()
    return _Rules(rows, bool(has["typing"]), bool(has["chains"]))


def _rules(known: DataFrame) -> DataFrame:
    """(kind, a, b, axiom) of what the schema says: of class a also b, of property a also b, and so on, by the statement ``axiom``."""
    rows = known.filter(_is_schema())
    kind = F.coalesce(*[F.when(F.col("predicate") == p, k) for p, k in _KINDS.items()], F.when(F.col("object") == _SYMMETRIC, "symmetric").otherwise("transitive"))
    marks = F.col("predicate") == TYPE
    forth = F.struct(F.col("subject").alias("a"), F.when(~marks, F.col("object")).alias("b"))
    back = F.when(F.col("predicate").isin(*_BOTH), F.struct(F.col("object").alias("a"), F.col("subject").alias("b")))
    rows = rows.select(kind.alias("kind"), F.inline(F.filter(F.array(forth, back), lambda x: x.isNotNull())), F.col("id").alias("axiom"))
    # Of several statements that make one rule, the least stands for it.
    return rows.filter(F.col("b").isNull() | (F.col("a") != F.col("b"))).groupBy("kind", "a", "b").agg(F.min("axiom").alias("axiom"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame | None:
    """What of ``right`` some row of ``left`` leads to by (m, p), or None if nothing does.

    Many statements lead to few places, as all customers do to their nations. What is met is written, so that Spark knows its size: a few
    rows go to the tasks of ``left``, whose common places would else be one task's each.
    """
    met = cut_lineage(right.join(cut_lineage(left.select("m", "p").distinct(), "ends"), ["m", "p"], "left_semi"), "met")
    return met if met.limit(1).count() else None


def _consequences(delta: DataFrame, every: DataFrame, rules: _Rules, kept: Callable[[DataFrame], DataFrame] = lambda x: x, leads: bool = False) -> DataFrame:
    """What one rule makes of a statement of ``delta``, and of another of ``every`` where a rule takes two: each statement once.

    Where a rule takes two, that of ``delta`` is either of them; with ``leads`` it is the first. ``kept`` takes those that are asked for, by their ids, before several derivations of one are told apart. ``rule`` and ``premises`` (statement ids: the data, then the axiom) are those of the least derivation. Classes are also taken from what
    a rule about a predicate has just said; such chained derivations come after direct ones, so that none rests on itself.
    """
    s, p, o, a, b, kind = (F.col(x) for x in ("subject", "predicate", "object", "a", "b", "kind"))
    is_iri, none = F.col("object_kind") == "iri", F.lit(None).cast("string")

    def derived(df: DataFrame, rule: Column, premises: Column, chained: int, **columns: Column) -> DataFrame:
        made = df.select(*[columns[c].alias(c) for c in _STATEMENT], rule.alias("rule"), premises.alias("premises"), F.lit(chained).alias("chained"))
        return made.select(*_STATEMENT, statement_id().alias("id"), "rule", "premises", "chained")

    # One pass over what is new for the rules about its predicate, and one for those about its class.
    hits = delta.join(rules.rows.filter(kind.isin("property", "domain", "range", "inverse", "symmetric")), p == a).filter(kind.isin("property", "domain") | is_iri)
    by_predicate = derived(
        hits, kind, F.array("id", "axiom"), 0,
        subject=F.when(kind.isin("range", "inverse", "symmetric"), o).otherwise(s),
        predicate=F.when(kind.isin("property", "inverse"), b).when(kind == "symmetric", p).otherwise(F.lit(TYPE)),
        object_kind=F.when(kind == "property", F.col("object_kind")).otherwise(F.lit("iri")),
        object=F.when(kind == "property", o).when(kind.isin("inverse", "symmetric"), s).otherwise(b),
        datatype=F.when(kind == "property", F.col("datatype")),
        language=F.when(kind == "property", F.col("language")),
    )
    classes, is_type = rules.rows.filter(kind == "class"), (p == TYPE) & is_iri
    parts = [by_predicate]
    for chained, rows in ((0, delta), *(((1, by_predicate),) if rules.typing else ())):
        typed = rows.filter(is_type).select("subject", "object", "id").join(classes, o == a)
        parts.append(derived(typed, F.lit("class"), F.array("id", "axiom"), chained, subject=s, predicate=F.lit(TYPE), object_kind=F.lit("iri"), object=b, datatype=none, language=none))
    chains = rules.rows.filter(kind == "transitive").select(a.alias("predicate"), "axiom")
    both = ((delta, every),) if leads or delta is every else ((delta, every), (every, delta))
    # Most rounds add nothing that chains, and needn't look at all that is known.
    chain = rules.chains and delta.filter(is_iri).join(chains.select("predicate"), "predicate", "left_semi").limit(1).count()
    for first, second in both if chain else ():
        left = first.filter(is_iri).join(chains, "predicate").select(s.alias("s"), p.alias("p"), o.alias("m"), F.col("id").alias("one"), "axiom")
        right = second.filter(is_iri).join(chains.select("predicate"), "predicate", "left_semi").select(s.alias("m"), p.alias("p"), o.alias("o"), F.col("id").alias("two"))
        right = _met(left, right)
        if right is None:
            continue
        parts.append(derived(left.join(right, ["m", "p"]), F.lit("transitive"), F.array("one", "two", "axiom"), 0, subject=F.col("s"), predicate=F.col("p"), object_kind=F.lit("iri"), object=F.col("o"), datatype=none, language=none))
    least = F.min(F.struct("chained", "rule", "premises", *_STATEMENT)).alias("x")
    return kept(reduce(DataFrame.unionByName, parts)).groupBy("id").agg(least).select(*[F.col(f"x.{c}").alias(c) for c in _STATEMENT], "id", F.col("x.rule").alias("rule"), F.col("x.premises").alias("premises"))


def _unknown(candidates: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Candidates whose ids no table has. Each table is asked alone: it lies in buckets of its ids and isn't moved."""
    return reduce(lambda rows, t: rows.join(t.select("id"), "id", "left_anti"), tables, candidates)


def _settle(tables: list[DataFrame], delta: DataFrame | None, first: int, max_iter: int, rules: _Rules | None = None) -> tuple[list[DataFrame], int]:
    """Rounds until nothing is added: each one's new statements with their iteration, and the number of the last round.

    ``delta`` is what is new to the first round, None if that is everything; ``rules`` are those of the tables, None if they aren't known.
    """
    found, tables = [], list(tables)
    for rounds in range(first, max_iter + 1):
        every = reduce(DataFrame.unionByName, [t.select(*_STATEMENT, "id") for t in tables])
        if rules is None:
            rules = _kept_rules(every)
        news = every if delta is None else delta.select(*_STATEMENT, "id")
        before = list(tables)
        new = bucketed(_consequences(news, every, rules, lambda x: _unknown(x, before)).withColumn("iteration", F.lit(rounds)), "id")
        count, schema = new.agg(F.count("*"), F.count_if(_is_schema())).first()
        if not count:
            return found, rounds
        found.append(new)
        tables.append(new)
        delta = new
        if schema:
            # New schema statements concern old data too, so the next round looks at everything.
            rules, delta = None, None
    raise RuntimeError(f"no fixed point in {max_iter} rounds")


def _as_inferred(found: list[DataFrame], empty: DataFrame) -> DataFrame:
    if not found:
        return empty.limit(0).select(*_STATEMENT, F.lit(0).alias("iteration"), F.lit(RULE_SET).alias("rule_set"), F.lit("").alias("rule"), F.array(F.lit("")).alias("support"))
    rows = reduce(DataFrame.unionByName, [x.select(*_DERIVED, "iteration") for x in found])
    return rows.select(*_STATEMENT, "iteration", F.lit(RULE_SET).alias("rule_set"), "rule", F.col("premises").alias("support"))


def closure(quads: DataFrame, max_iter: int = ROUNDS) -> tuple[DataFrame, int]:
    """(inferred, rounds): inferred statements with iteration, rule_set, rule and support, none of which was given.

    Rules: subclass and subproperty, equivalence both ways, type propagation, domain, range of IRI objects, inverse both ways, symmetric
    and transitive properties. ``rule`` is the one that gave the statement first, ``support`` the ids of its premises (``statement_id``):
    one or two statements, then the axiom. ``rounds`` counts the last one, that adds nothing. Statements that haven't settled in
    ``max_iter`` rounds are an error, never a closure that is cut.
    """
    closed = close(quads, max_iter)
    return closed.inferred, closed.rounds


def close(quads: DataFrame, max_iter: int = ROUNDS) -> Closed:
    """The closure with its tables, from which ``maintain_closed`` goes on without writing or hashing them again."""
    base = _given(quads)
    return Closed(base, *_settle([base], None, 1, max_iter))


def _given(quads: DataFrame) -> DataFrame:
    return bucketed(spread(quads.select(*_STATEMENT, statement_id().alias("id")), "id").distinct(), "id")


def with_premises(inferred: DataFrame, quads: DataFrame) -> DataFrame:
    """Adds ``because``: the premises of each inferred statement as text, in the order of its support, looked up by their ids.

    Axioms, and what transitive statements lead to, are the premises of very many: the few that are asked for come to the tasks that ask.
    """
    text = F.concat_ws(" ", "subject", "predicate", "object")
    given = spread(quads.select(*_STATEMENT)).distinct()
    texts = given.unionByName(inferred.select(*_STATEMENT)).select(statement_id().alias("premise"), text.alias("text"))
    support = F.col("support")
    out = inferred.withColumns({"_one": F.get(support, F.lit(0)), "_two": F.when(F.size(support) > 2, F.get(support, F.lit(1))), "_axiom": F.element_at(support, -1)})
    for name in ("_one", "_two", "_axiom"):
        said = texts
        if name != "_one":
            asked = cut_lineage(out.filter(F.col(name).isNotNull()).select(F.col(name).alias("premise")).distinct(), "asked")
            said = cut_lineage(texts.join(asked, "premise", "left_semi"), "said")
        out = out.join(said.select(F.col("premise").alias(name), F.col("text").alias(f"{name}_text")), name, "left")
    return out.withColumn("because", F.concat_ws("; ", "_one_text", "_two_text", "_axiom_text")).select(*inferred.columns, "because")


def inference_run(quads: DataFrame, folder: str) -> tuple[DataFrame, bool]:
    """The closure of these statements under this rule set below ``folder``, and whether it was there: a run that was written whole is read
    again. It goes by the digest of the distinct statements, whatever graphs they are in and in whatever order they come.
    """
    spark = quads.sparkSession
    statements = quads.select(*_STATEMENT).distinct()
    path = f"{folder}/{RULE_SET}-{digest_of(statements).first()['digest']}"
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    reused = whole.getFileSystem(spark._jsc.hadoopConfiguration()).exists(whole)
    if not reused:
        closure(quads)[0].write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), reused


def maintain(quads: DataFrame, inferred: DataFrame, added: DataFrame, withdrawn: DataFrame, max_iter: int = ROUNDS) -> DataFrame:
    """The closure after some statements came and others went, from the one before: see ``maintain_closed``.

    ``quads`` and ``inferred`` are as they were, ``added`` and ``withdrawn`` quads; what is in both stays or comes.
    """
    old = bucketed(inferred.select(*_STATEMENT, statement_id().alias("id"), "rule", F.col("support").alias("premises"), "iteration"), "id")
    last = old.agg(F.coalesce(F.max("iteration"), F.lit(0))).first()[0]
    return maintain_closed(Closed(_given(quads), [old], last), added, withdrawn, max_iter).inferred


def _premises(wanted: DataFrame, tables: list[DataFrame], rules: _Rules) -> DataFrame:
    """The statements of ``tables`` of which one rule may make a statement of ``wanted``: where it takes two, the first.

    What one statement follows from by most rules is itself a statement that one can name, so it is asked for by its id where it lies.
    Of domains and ranges all premises are taken, and so are IRIs with a datatype or a language, that no rule keeps.
    """
    s, p, o, a, b, kind = (F.col(x) for x in ("subject", "predicate", "object", "a", "b", "kind"))
    is_iri, none, columns = F.col("object_kind") == "iri", F.lit(None).cast("string"), [*_STATEMENT, "id"]
    same = kind == "property"
    by_predicate = wanted.join(rules.rows.filter(kind.isin("property", "inverse", "symmetric")).withColumn("to", F.coalesce(b, a)), p == F.col("to")).filter(same | is_iri)
    asked = by_predicate.select(F.when(same, s).otherwise(o).alias("subject"), a.alias("predicate"), "object_kind", F.when(same, o).otherwise(s).alias("object"), "datatype", "language")
    by_class = wanted.filter((p == TYPE) & is_iri).join(rules.rows.filter(kind == "class"), o == b)
    asked = asked.unionByName(by_class.select("subject", "predicate", "object_kind", a.alias("object"), none.alias("datatype"), none.alias("language")))
    asked = cut_lineage(asked.select(statement_id().alias("id")).distinct(), "asked")
    parts = [t.select(*columns).join(asked, "id", "left_semi") for t in tables]
    every = reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])
    parts.append(every.filter(is_iri & (F.col("datatype").isNotNull() | F.col("language").isNotNull())))
    if rules.typing:
        parts.append(every.join(rules.rows.filter(_gives_class()).select(a.alias("predicate")), "predicate", "left_semi").select(*columns))
    if rules.chains:
        chains = rules.rows.filter(kind == "transitive").select(a.alias("predicate"))
        starts = cut_lineage(wanted.join(chains, "predicate", "left_semi").select("subject", "predicate").distinct(), "starts")
        parts.append(every.filter(is_iri).join(chains, "predicate", "left_semi").join(starts, ["subject", "predicate"], "left_semi").select(*columns))
    return cut_lineage(reduce(DataFrame.unionByName, parts), "premises")


def maintain_closed(closed: Closed, added: DataFrame, withdrawn: DataFrame, max_iter: int = ROUNDS) -> Closed:
    """The closure after some statements came and others went, from the one before: delete and rederive.

    All that rests on a withdrawn statement goes first; what has another derivation left comes back in one pass over its premises, and only
    from there and from what was added do rounds go on. Of what stays nothing is moved. A change of the schema concerns all data and is
    computed anew. Iterations of statements that come back are counted on from those before.
    """
    before, gone, come = closed.given, _given(withdrawn), _given(added)
    gone = bucketed(gone.join(come.select("id"), "id", "left_anti").join(before.select("id"), "id", "left_semi"), "id")
    stay = bucketed(before.join(gone.select("id"), "id", "left_anti"), "id")
    fresh = bucketed(come.join(before.select("id"), "id", "left_anti"), "id")
    changed = gone.unionByName(come).agg(F.count_if(_is_schema())).first()[0]
    if changed:
        return close(stay.unionByName(fresh), max_iter)
    every = reduce(DataFrame.unionByName, [t.select(*before.columns) for t in (before, *closed.found)])
    rules = _kept_rules(every)
    lost, delta, schema_lost = [gone], gone, 0
    for _ in range(max_iter):
        # All that follows is known; what was given and stays doesn't fall.
        out = [before, *lost[1:]]
        reached = _consequences(delta, every, rules, lambda x: _unknown(x, out))
        delta = bucketed(reached.select(*before.columns), "id")
        count, schema = delta.agg(F.count("*"), F.count_if(_is_schema())).first()
        if not count:
            break
        schema_lost += schema
        lost.append(delta)
    else:
        raise RuntimeError(f"no fixed point in {max_iter} rounds")
    if schema_lost:
        return close(stay.unionByName(fresh), max_iter)
    doubtful = bucketed(reduce(DataFrame.unionByName, lost), "id")
    tables = [stay, fresh]
    kept = [bucketed(_unknown(t, [doubtful, fresh]), "id") for t in closed.found]
    tables += kept
    left = reduce(DataFrame.unionByName, [t.select(*before.columns) for t in tables])
    last = closed.rounds + 1
    back = _consequences(_premises(doubtful, tables, rules), left, rules, lambda x: _unknown(x.join(doubtful.select("id"), "id", "left_semi"), tables), leads=True)
    back = bucketed(back.withColumn("iteration", F.lit(last)), "id")
    found, rounds = _settle([*tables, back], back.select(*before.columns).unionByName(come), last + 1, last + max_iter, rules)
    given = stay.unionByName(fresh)
    return Closed(given, [*kept, back, *found], rounds)


def with_inferred(quads: DataFrame, inferred: DataFrame, graph: str = "inferred") -> DataFrame:
    """Given and inferred statements in one read, with ``inferred`` and the iteration; a statement that is both is given."""
    given = quads.withColumns({"inferred": F.lit(False), "iteration": F.lit(0)})
    more = inferred.select(F.lit(graph).alias("graph"), *_KEY, "datatype", "language", F.lit(True).alias("inferred"), "iteration")
    on = [F.col(f"m.{k}").eqNullSafe(F.col(f"q.{k}")) for k in (*_KEY, "datatype", "language")]
    return given.unionByName(more.alias("m").join(quads.alias("q"), reduce(lambda x, y: x & y, on), "left_anti").select(given.columns))
