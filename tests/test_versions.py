"""Comparing value trees, and versions as rows."""

from quire.functions import write as W
from quire.functions.lexer import Value
from quire.operators import versions as V
from quire.operators.corpus import Corpus
from tests.test_operators import files, rows


def tree(spark, *objects):
    c = Corpus.from_binary(files(spark, W.assemble([(1, W.dictionary(Type="Catalog")), *objects], {"Root": W.ref(1)})))
    return Corpus(c.parsed.cache()).nodes.where("obj_num >= 0")


def test_changes_of_trees(spark):
    d = W.dictionary
    old = tree(spark, (2, d(A=1, B=[1, 2, d(X=1)], C=d(D=d(E=5)), S=Value("LiteralString", "x"))), (3, W.wrap(1)), (5, W.wrap([1, 2])), (6, W.wrap([[1], [2]])))
    new = tree(spark, (2, d(S=Value("HexString", "x"), A=1, B=[1, 3, d(X=1), 4], C=d(D=d(E=6, F=1)))), (4, W.wrap(1)), (5, d(A=1)), (6, W.wrap([[2], [1]])))
    assert rows(V.diff(old, new), "obj_num", "key_path", "change") == {
        (2, "B.[1]", "changed"), (2, "B.[3]", "added"), (2, "C.D.E", "changed"), (2, "C.D.F", "added"), (2, "S", "changed"), (3, None, "removed"), (4, None, "added"), (5, None, "changed"),
        (6, "[0].[0]", "changed"), (6, "[1].[0]", "changed")}
    assert V.diff(old, old).count() == 0
    assert rows(V.diff(old.limit(0), tree(spark)), "obj_num", "change") == {(1, "added")}


def store(spark, data):
    return spark.createDataFrame([(p, v, n, None if x is None else bytearray(x), x is None) for p, v, n, x in data], V.STORE)


def edits(spark, data):
    return spark.createDataFrame([(p, n, None if x is None else bytearray(x)) for p, n, x in data], "path string, name string, data binary")


def test_versions_as_rows(spark):
    s = V.begin(edits(spark, [("p", "a", b"1"), ("p", "b", b"2"), ("q", "a", b"3")]))
    s = s.union(V.commit(s, edits(spark, [("p", "a", b"9"), ("p", "b", b"2"), ("p", "zz", None), ("p", "c", b"")])))
    s = s.union(V.commit(s, edits(spark, [("p", "b", None), ("new", "x", b"5")]))).cache()
    seen = lambda v: {(r.path, r.name, bytes(r.data)) for r in V.as_of(s, v).collect()}
    assert seen(0) == {("p", "a", b"1"), ("p", "b", b"2"), ("q", "a", b"3"), ("new", "x", b"5")}
    assert seen(1) >= {("p", "a", b"9"), ("p", "b", b"2"), ("p", "c", b"")} and ("p", "b", b"2") not in seen(None)
    back = s.union(V.restore(s, 0)).cache()
    assert {(r.path, r.name, bytes(r.data)) for r in V.as_of(back).collect()} == seen(0)
    assert rows(V.history(back).where("path = 'p'"), "version", "n_files", "n_deleted") == {(0, 2, 0), (1, 2, 0), (2, 1, 1), (3, 3, 1)}
    assert V.restore(back, 3).where("path = 'p'").count() == 0 and V.commit(back, edits(spark, [])).count() == 0


def test_a_version_is_written_once(spark, monkeypatch):
    """The store of the query gets each version's own rows, not those before it again."""
    from quire.plans import queries as Q

    sizes, real = [], Q.written

    def counted(df, label):
        out = real(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(Q, "written", counted)
    Q.q93(spark, "/root/testdata/sf0.001")
    n = Q.table(spark, "/root/testdata/sf0.001", "documents").count()
    assert sizes[0] >= 6 * n and sizes[1] == n and all(x < n for x in sizes[2:])


def test_a_version_is_dealt_out_once(spark):
    """A version by path is linked where its rows met: one shuffle, not one for its rows and another for its files."""
    from quire.operators import pdfx
    from quire.session import joins_as_given, joins_by_measure

    joins_by_measure(spark)
    store = spark.createDataFrame([(f"{i}.pdf", 0, n, bytes([i]), False) for i in range(20) for n in ("x", "y")], V.STORE)
    plan = pdfx.link(V.as_of(store, 0, 3))._jdf.queryExecution().executedPlan().toString()
    joins_as_given(spark)
    assert plan.count("Exchange") == 1 and V.as_of(store, 0, 3).count() == 40


def test_unions_of_tables_by_path_keep_their_groups_whole(spark):
    """Rows of one path lie in several tables by path; a group of their union has them all."""
    from quire.session import joins_as_given, joins_by_measure, written_by_path

    joins_by_measure(spark)
    tables = [written_by_path(spark.range(60).selectExpr("concat(id, '.pdf') path", f"{k} k", "id v").repartition(6, "path"), "test", 6) for k in range(3)]
    every = tables[0].union(tables[1]).union(tables[2])
    sums = every.groupBy("path").agg({"k": "sum"}).withColumnRenamed("sum(k)", "s")
    last = every.groupBy("path", "v").agg({"k": "max"}).withColumnRenamed("max(k)", "m")
    got = every.where("k < 2").join(sums, "path").join(last, ["path", "v"]).groupBy("path").agg({"s": "sum", "m": "sum"}).collect()
    joins_as_given(spark)
    assert len(got) == 60 and all(sorted((r[1], r[2])) == [4, 6] for r in got)
