import random

import pytest
from pyspark.sql import functions as F

from semforge.functions.iri import EX, OWL, RDF, RDFS, TYPE, XSD
from semforge.plans import more
from semforge.rdf import sinks
from semforge.rdf import closure as closures
from semforge.rdf.closure import closure, with_inferred
from semforge.rdf.store import store
from semforge.rdf.shapes import read_shapes, validate_shapes
from semforge.rdf.turtle import QUAD, TurtleError, parse, read_turtle
from semforge.sparql import SparqlError, ask, select
from semforge.sparql import parse as parse_query

TTL = """
@prefix ex: <https://semantic.local/ontology/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix owl: <http://www.w3.org/2002/07/owl#> .
# comment with <iri> and "quote"
ex:Pump rdfs:subClassOf ex:Device . ex:Device rdfs:subClassOf ex:Object . ex:Object rdfs:subClassOf ex:Pump .
ex:near a owl:SymmetricProperty . ex:above a owl:TransitiveProperty . ex:owns owl:inverseOf ex:ownedBy ; rdfs:domain ex:Owner ; rdfs:range ex:Device .
ex:Machine owl:equivalentClass ex:Device . ex:touches rdfs:subPropertyOf ex:near .
ex:p1 a ex:Pump ; ex:name "泵 \\"1\\""@zh , "pump" ; ex:touches ex:p2 ; ex:size 5 , 2.5 , 1e3 ; ex:on true .
ex:p2 a ex:Device ; ex:above ex:p3 ; ex:name "two" . ex:p3 ex:above ex:p4 . ex:o ex:owns ex:p1 ; ex:owns "text" .
"""


@pytest.fixture(scope="module")
def quads(spark):
    return read_turtle(spark, TTL, "g").cache()


def test_turtle():
    t = parse(TTL)
    assert (f"{EX}p1", f"{EX}name", ("literal", '泵 "1"', f"{RDF}langString", "zh")) in t
    assert (f"{EX}p1", f"{EX}size", ("literal", "1e3", f"{XSD}double", None)) in t and len(t) == 24
    nested = parse('@prefix e: <http://e/> . e:a e:b [ e:c ( 1 "x" ) ; e:d """long\ntext""" ] .')
    assert sum(p == f"{RDF}first" for _, p, _ in nested) == 2
    for bad in ("ex:a ex:b ex:c .", "<a:b> <c:d>", '<a:b> <c:d> "open .'):
        with pytest.raises((TurtleError, StopIteration)):
            parse(bad)


def slow_closure(triples):
    """Naive evaluation of the same rules over (s, p, o, is_iri)."""
    known = set(triples)
    while True:
        sub = {(s, o) for s, p, o, i in known if p in (f"{RDFS}subClassOf", f"{OWL}equivalentClass")} | {(o, s) for s, p, o, i in known if p == f"{OWL}equivalentClass"}
        prop = {(s, o) for s, p, o, i in known if p == f"{RDFS}subPropertyOf"}
        new = set()
        for s, p, o, i in known:
            if p == TYPE and i:
                new |= {(s, TYPE, b, True) for a, b in sub if a == o}
            new |= {(s, b, o, i) for a, b in prop if a == p}
            for s2, p2, o2, _ in known:
                if s2 == p and p2 == f"{RDFS}domain":
                    new.add((s, TYPE, o2, True))
                if s2 == p and p2 == f"{RDFS}range" and i:
                    new.add((o, TYPE, o2, True))
                if p2 == f"{OWL}inverseOf" and i and p in (s2, o2):
                    new.add((o, o2 if p == s2 else s2, s, True))
                if (s2, p2, o2) == (p, TYPE, f"{OWL}SymmetricProperty") and i:
                    new.add((o, p, s, True))
                if p2 == p and s2 == o and (p, TYPE, f"{OWL}TransitiveProperty", True) in known:
                    new.add((s, p, o2, True))
        if new <= known:
            return known - set(triples)
        known |= new


def test_closure(quads):
    base = {(r.subject, r.predicate, r.object, r.object_kind == "iri") for r in quads.collect()}
    inferred, rounds = closure(quads)
    rows = inferred.collect()
    assert {(r.subject, r.predicate, r.object, r.object_kind == "iri") for r in rows} == slow_closure(base)
    assert len(rows) == len({(r.subject, r.predicate, r.object) for r in rows}) and 2 <= rounds <= 6 and {r.iteration for r in rows} <= set(range(1, rounds))
    whole = quads.unionByName(inferred.selectExpr("'i' AS graph", *quads.columns[1:]))
    assert closure(whole)[0].count() == 0


def test_closure_without_end(quads):
    with pytest.raises(RuntimeError, match="no fixed point"):
        closure(quads, max_iter=1)


def test_transitive_by_joins(spark, monkeypatch):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "g")], "a string, b string")
    few = {tuple(r) for r in closures.transitive(pairs).collect()}
    monkeypatch.setattr(closures, "FEW_PAIRS", 0)
    assert {tuple(r) for r in closures.transitive(pairs).collect()} == few and len(few) == 15


def check_derivations(quads, inferred):
    """Every inferred statement follows by its rule from premises that are given or were inferred no later, without a circle."""
    columns = ["subject", "predicate", "object_kind", "object", "datatype", "language"]
    ident = closures.statement_id().alias("id")
    given = {r.id: r for r in quads.select(*columns, ident).distinct().collect()}
    rows = {r.id: r for r in inferred.withColumn("id", closures.statement_id()).collect()}
    assert not set(given) & set(rows)
    every, sub = given | rows, f"{RDFS}subClassOf"
    for r in rows.values():
        *data, axiom = [every[x] for x in r.support]
        (one, *more), s, p, o = data, r.subject, r.predicate, r.object
        assert len(more) == (r.rule == "transitive")
        assert all(x.iteration <= r.iteration for x in map(rows.get, r.support) if x is not None)
        if r.rule == "class":
            assert (one.subject, one.predicate, p) == (s, TYPE, TYPE) and axiom.predicate in (sub, f"{OWL}equivalentClass") and (one.object, o) in ((axiom.subject, axiom.object), (axiom.object, axiom.subject)) and (axiom.predicate != sub or one.object == axiom.subject)
        elif r.rule == "property":
            assert (one.subject, one.object) == (s, o) and {one.predicate, p} == {axiom.subject, axiom.object}
        elif r.rule in ("domain", "range"):
            assert axiom.predicate == f"{RDFS}{r.rule}" and axiom.subject == one.predicate and (p, o) == (TYPE, axiom.object) and s == (one.subject if r.rule == "domain" else one.object)
        elif r.rule == "inverse":
            assert (one.subject, one.object) == (o, s) and {one.predicate, p} == {axiom.subject, axiom.object} and axiom.predicate == f"{OWL}inverseOf"
        elif r.rule == "symmetric":
            assert (one.subject, one.predicate, one.object) == (o, p, s) and (axiom.subject, axiom.object) == (p, f"{OWL}SymmetricProperty")
        else:
            (two,) = more
            assert (one.subject, two.object) == (s, o) and one.object == two.subject and one.predicate == two.predicate == p and (axiom.subject, axiom.object) == (p, f"{OWL}TransitiveProperty")
    # No statement rests on itself.
    sure = set(given)
    while todo := [i for i, r in rows.items() if i not in sure and set(r.support) <= sure]:
        sure.update(todo)
    assert sure == set(every)


def test_derivations(quads):
    check_derivations(quads, closure(quads)[0])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_maintained_closure(spark, seed):
    """After random statements came and went, the maintained closure is the one computed anew, with sound derivations."""
    rng = random.Random(seed)
    schema = [(f"{EX}C{k}", f"{RDFS}subClassOf", f"{EX}C{(k + 1) % 5}") for k in range(5)] + [(f"{EX}p", f"{RDFS}subPropertyOf", f"{EX}q"), (f"{EX}q", TYPE, f"{OWL}TransitiveProperty"), (f"{EX}r", f"{OWL}inverseOf", f"{EX}q"), (f"{EX}s", TYPE, f"{OWL}SymmetricProperty"), (f"{EX}p", f"{RDFS}domain", f"{EX}C0"), (f"{EX}s", f"{RDFS}range", f"{EX}C7")]

    def some(n):
        return {(f"{EX}i{rng.randrange(8)}", f"{EX}{rng.choice('pqrs')}", f"{EX}i{rng.randrange(8)}") for _ in range(n)} | {(f"{EX}i{rng.randrange(8)}", TYPE, f"{EX}C{rng.randrange(6)}") for _ in range(2)}

    def frame(rows):
        return spark.createDataFrame([("g", s, p, "iri", o, None, None) for s, p, o in sorted(rows)], QUAD)

    data = some(9)
    withdrawn, added = set(rng.sample(sorted(data), 4)), some(2)
    if seed == 3:
        withdrawn.add(schema[1])
    before, after = frame({*schema, *data}), frame(({*schema, *data} - withdrawn) | added)
    old = closure(before)[0]
    got, want = closures.maintain(before, old, frame(added), frame(withdrawn)), closure(after)[0]
    key = ["subject", "predicate", "object"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    check_derivations(after, got)


def test_a_small_change_looks_at_few_statements(spark, monkeypatch):
    """Two nodes move among many: no round starts from more than what hangs on them."""
    q, inner, started = hub(spark, 60), closures._consequences, []
    closed = closures.close(q)
    at, to = (spark.createDataFrame([("g", f"{EX}n{k}", f"{EX}in", "iri", f"{EX}place{p}", None, None) for k in (2, 4)], QUAD) for p in (0, 1))
    monkeypatch.setattr(closures, "_consequences", lambda delta, *more, **named: started.append(delta.count()) or inner(delta, *more, **named))
    got = closures.maintain_closed(closed, to, at).inferred.select("subject", "predicate", "object").collect()
    assert len(started) > 5 and max(started) < 20
    where = {f"{EX}n{k}": f"{EX}place{1 if k in (2, 4) else k % 2}" for k in range(60)}
    paths = [*where.items(), *((n, f"{EX}top") for n in where)]
    want = [(n, f"{EX}partOf", x) for n, x in paths] + [(x, f"{EX}hasPart", n) for n, x in [*paths, *((f"{EX}place{k}", f"{EX}top") for k in range(2))]]
    assert sorted(map(tuple, got)) == sorted(want)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hub(spark, n):
    """n nodes that are part of one of two places, which are part of a third; part of has an inverse and is transitive."""
    schema = [(f"{EX}in", f"{RDFS}subPropertyOf", f"{EX}partOf"), (f"{EX}partOf", TYPE, f"{OWL}TransitiveProperty"), (f"{EX}partOf", f"{OWL}inverseOf", f"{EX}hasPart")]
    data = [(f"{EX}n{k}", f"{EX}in", f"{EX}place{k % 2}") for k in range(n)] + [(f"{EX}place{k}", f"{EX}partOf", f"{EX}top") for k in range(2)]
    return spark.createDataFrame([("g", s, p, "iri", o, None, None) for s, p, o in schema + data], QUAD)


def test_a_common_place_is_no_tasks_own(spark, monkeypatch):
    """All nodes lead to two places: only these rows are joined, and they come to where the nodes are."""
    met, inner, lookups = [], closures._met, []
    monkeypatch.setattr(closures, "_met", lambda a, b: met.append(inner(a, b)) or met[-1])
    q = hub(spark, 200)
    inferred, _ = closure(q)
    assert inferred.count() == 200 * 4 + 2 and {2} <= {x.count() for x in met if x is not None} and None in met
    cut = closures.cut_lineage
    monkeypatch.setattr(closures, "cut_lineage", lambda df, name="step": lookups.append((name, cut(df, name))) or lookups[-1][1])
    rows = closures.with_premises(inferred, q).collect()
    assert len(rows) == 802 and [x.count() for n, x in lookups if n == "said"] == [2, 3]
    why = {(r.subject, r.predicate, r.object): r.because.replace(EX, "").replace(OWL, "").replace(TYPE, "a") for r in rows}
    assert why[f"{EX}n3", f"{EX}partOf", f"{EX}top"] == "n3 partOf place1; place1 partOf top; partOf a TransitiveProperty"
    assert why[f"{EX}place1", f"{EX}hasPart", f"{EX}n3"] == "n3 partOf place1; partOf inverseOf hasPart"


def test_stored_star_needs_no_exchange(spark, quads):
    """Patterns about one subject join and lose repeated statements within the buckets; rows are those of the quads themselves."""
    twice = quads.unionByName(quads.withColumn("graph", F.lit("h")))
    kept = store(twice, 4)
    query = P + "SELECT ?s ?n ?t WHERE { ?s a ?c ; ex:name ?n ; ex:touches ?t . }"
    n = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored, loose = select(kept, query, cap=None), select(twice, query, cap=None)
        assert "Exchange" not in plan_of(stored) and "Exchange" in plan_of(loose)
        assert names(stored) == names(loose) == [("p1", "pump", "p2"), ("p1", '泵 "1"', "p2")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", n)
    assert kept.counts[f"{EX}name"] == 6 and kept.rows(None) == twice.count() and kept.rows("other") == 0
    both = P + "SELECT ?s WHERE { ?s ex:above ?o . ?o ex:above ?x ; a ?k }"
    assert names(select(kept, both)) == names(select(quads, both))
    same = P + "SELECT ?s WHERE { ?s ex:touches ?o ; ex:name ?o }"
    assert names(select(kept, same)) == names(select(quads, same)) == []


def test_given_and_inferred(quads):
    inferred, _ = closure(quads)
    both = with_inferred(quads, inferred.unionByName(quads.limit(2).select(*inferred.columns[:6]).selectExpr("*", "1 AS iteration", "'x' AS rule_set", "'class' AS rule", "array('p') AS support")))
    assert both.filter("inferred").count() == inferred.count() and both.filter("NOT inferred").count() == quads.count()


SHAPES = """
@prefix ex: <https://semantic.local/ontology/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
ex:S a sh:NodeShape ; sh:targetClass ex:Device ; sh:closed true ; sh:ignoredProperties ( ex:above ) ; sh:message "shape" ; sh:severity sh:Warning ;
  sh:property [ sh:path ex:name ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:message "name" ; sh:severity sh:Violation ] ;
  sh:property [ sh:path ex:kind ; sh:in ( "a" "b" ) ] ; sh:property [ sh:path ex:at ; sh:class ex:Place ; sh:nodeKind sh:IRI ] .
"""


def test_shapes(spark):
    data = """@prefix ex: <https://semantic.local/ontology/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
    ex:Room rdfs:subClassOf ex:Place . ex:r a ex:Room . ex:d1 a ex:Device ; ex:name "x" ; ex:kind "a" ; ex:at ex:r ; ex:above ex:d2 .
    ex:d2 a ex:Device ; ex:name "x", "y" ; ex:kind "c" ; ex:at "text" . ex:d3 a ex:Device ; ex:extra 1 ; ex:at ex:d1 . ex:pump a ex:Pump ."""
    out = validate_shapes(read_turtle(spark, data, "g"), read_shapes(SHAPES)).collect()
    got = {(r.focus.removeprefix(EX), r.path.removeprefix(EX), r.code) for r in out}
    assert got == {("d2", "name", "maxCount"), ("d2", "kind", "in"), ("d2", "at", "nodeKind"), ("d2", "at", "class"), ("d3", "name", "minCount"), ("d3", "extra", "closed"), ("d3", "at", "class")}
    assert {(r.severity, r.message) for r in out} == {("Violation", "name"), ("Warning", "shape")}
    assert validate_shapes(spark.createDataFrame([], QUAD), read_shapes(SHAPES)).count() == 0


P = f"PREFIX ex: <{EX}> PREFIX rdfs: <{RDFS}> "


def names(df):
    return sorted(tuple(None if v is None else v.removeprefix(EX) for v in r) for r in df.collect())


def test_sparql(quads):
    run = lambda q: names(select(quads, P + q))
    assert run("SELECT ?s WHERE { ?s a ex:Pump }") == [("p1",)]
    assert run("SELECT ?s ?n WHERE { ?s a ?c . OPTIONAL { ?s ex:name ?n FILTER(LANG(?n) = 'zh') } FILTER(?c IN (ex:Pump, ex:Device)) }") == [("p1", '泵 "1"'), ("p2", None)]
    assert run("SELECT ?x WHERE { ?x ex:size ?n FILTER(?n > 4 && ?n < 100) }") == [("p1",)]
    assert run("SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?t) WHERE { ?x ex:size ?v }") == [("3", "1007.5")]
    assert run("SELECT ?o WHERE { ex:p2 ex:above+ ?o }") == [("p3",), ("p4",)]
    assert run("SELECT ?o WHERE { ex:p2 ex:above* ?o }") == [("p2",), ("p3",), ("p4",)]
    assert run("SELECT ?s WHERE { ?s ^ex:owns/^ex:touches? ?x FILTER(?x = ex:o) }") == [("p1",), ("text",)]
    assert run("SELECT ?s WHERE { ?s ex:name ?n MINUS { ?s a ex:Pump } }") == [("p2",)]
    assert run("SELECT DISTINCT ?s WHERE { ?s ex:name ?n FILTER NOT EXISTS { ?s ex:touches ?t } }") == [("p2",)]
    assert run("SELECT ?s ?k WHERE { VALUES (?s ?k) { (ex:p1 1) (ex:p2 UNDEF) } ?s a ?c }") == [("p1", "1"), ("p2", None)]
    assert run("SELECT ?n WHERE { { ?s ex:name ?n } UNION { ?s ex:on ?n } FILTER(STRLEN(STR(?n)) < 5) } ORDER BY DESC(?n) LIMIT 2") == [("true",), ("two",)]
    assert run("SELECT ?c (COUNT(?s) AS ?n) WHERE { ?s a ?c } GROUP BY ?c HAVING (COUNT(?s) > 0) ORDER BY ?c")[0] == ("Device", "1")
    assert run("SELECT ?u WHERE { ex:p1 ex:name ?n BIND(UCASE(STR(?n)) AS ?u) FILTER REGEX(?u, '^pu', 'i') }") == [("PUMP",)]
    assert run("SELECT ?s WHERE { GRAPH ?g { ?s ex:on true } FILTER(BOUND(?g)) }") == [("p1",)]
    assert run("SELECT ?m WHERE { { SELECT (MAX(?v) AS ?m) WHERE { ?s ex:size ?v } } }") == [("1e3",)]
    assert ask(quads, P + "ASK { ex:p1 a ex:Pump }") and not ask(quads, P + "ASK { ex:p1 a ex:Fan }")


def test_sparql_refuses():
    for bad in ("INSERT DATA { <a:b> <a:b> <a:b> }", "SELECT ?x WHERE { SERVICE <a:b> { ?x ?y ?z } }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "SELECT WHERE { }", "SELECT ?x { ?x a ex:A }", "SELECT ?x WHERE { ?x a <a:b> ", "DELETE WHERE { ?s ?p ?o }"):
        with pytest.raises(SparqlError):
            parse_query(bad)
    for good in ("SELECT ?add WHERE { ?add <a:delete> 'insert' } # drop", "ASK { ?s ?p <urn:create> }"):
        assert parse_query(good)


def test_sinks(spark, quads):
    lines = [r.value for r in sinks.nquads(quads).collect()]
    assert f'<{EX}p1> <{EX}name> "泵 \\"1\\""@zh <g> .' in lines and f'<{EX}p1> <{EX}size> "5"^^<{XSD}integer> <g> .' in lines
    import json

    nodes = {n["@id"]: n for n in (json.loads(r.value) for r in sinks.jsonld(quads).collect())}
    assert nodes[f"{EX}p1"]["@type"] == [f"{EX}Pump"] and len(nodes[f"{EX}p1"][f"{EX}size"]) == 3
    assert sinks.trig(quads).count() == len(nodes)


@pytest.mark.parametrize("name", ["u3", "o11"])
def test_closures_read_customers(spark, monkeypatch, name):
    read = []

    def spy(quads):
        read.append(quads)
        return closure(quads)

    monkeypatch.setattr(more, "closure", spy)
    sf = "/root/testdata/sf0.001"
    rows = getattr(more, name)(spark, sf).collect()
    assert (rows[0]["n"] if name == "u3" else sum(r.object == f"{EX}Place" for r in rows)) == 30
    typed = read[0].filter((F.col("predicate") == TYPE) & F.col("subject").contains("/customer/"))
    assert typed.count() == spark.read.parquet(f"{sf}/customer.parquet").count()
