"""How the engine's queries are planned and staged."""

import os

import pytest

from quire import catalog
from quire.session import joins_as_given

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.mark.parametrize("name", ["q73_text_by_fonts", "q87_text_in_forms", "q89_mixed_codes"])
def test_no_join_is_broadcast_by_the_size_of_files(spark, name):
    before = spark.conf.get(STATIC), spark.conf.get(MEASURED, None)
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan
    joins_as_given(spark)
    assert spark.conf.get(STATIC) != "-1" and (before[0] == "-1" or (spark.conf.get(STATIC), spark.conf.get(MEASURED, None)) == before)


@pytest.mark.parametrize("name", ["q35_change_detection", "q71_change_status", "q37_repack", "q106_relink_streams"])
def test_files_are_made_and_parsed_once(spark, name):
    """What a result reads are tables of steps done: no file is generated, exploded or parsed again by it."""
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    joins_as_given(spark)
    assert "MapInArrow" not in plan


def test_manifest_of_exploded_files_is_that_of_the_files(spark):
    from quire.functions import write as W
    from quire.operators import pdfx

    rows = [(f"{i}.pdf", W.layout(k, "some (text)\nin lines", "en", "s")) for i, k in enumerate(("lay1", "lay2", "lay2p", "book", "rich"))] + [("9.pdf", b"broken")]
    files = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    one, two = pdfx.manifest(files), pdfx.manifest_of(pdfx.explode_files(files))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))
    assert two.where("error is not null").count() == 1 and two.count() > 30


def test_an_archive_is_made_and_read_in_one_worker_of_a_task(spark):
    """Each step of ``mapInArrow`` would hold a Python worker of its own: one for the files' digests, one for their archives."""
    from quire.plans.queries import table
    from quire.operators import pdfx
    from quire.sources import pdf

    plan = catalog.queries()["q48_archive_round_trip"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    joins_as_given(spark)
    assert plan.count("MapInArrow") == 2
    docs = table(spark, DATA, "documents").limit(20)
    apart = pdfx.import_zip(pdfx.export_zip(pdf.generate(docs, "lay2p")))
    one = pdf.generate(docs, "lay2p", then=pdfx.zipped_and_back())
    assert one.schema == apart.schema and sorted(map(str, one.collect())) == sorted(map(str, apart.collect())) and one.count() > 200


def test_objects_of_a_corpus_by_path_are_joined_where_they_are(spark):
    """Tables of a corpus lie by path: joins and groups by objects of a path have no shuffle, and the same rows as those of a corpus that has."""
    from quire.operators import formats, graph, text
    from quire.operators.corpus import Corpus
    from quire.plans.queries import table
    from quire.session import joins_by_measure
    from quire.sources import pdf

    joins_by_measure(spark)
    docs = table(spark, DATA, "documents").limit(40)
    plain = Corpus.from_binary(pdf.generate(docs, "rich"))
    by_path = Corpus(pdf.generate(docs, "rich", then=pdf.parsing(), tasks=5)).by_path("test", 5)
    for ask in (graph.reference_counts, lambda c: graph.resolve(c.nodes, c.objects), formats._image_inputs, text.content_bytes):
        one, two = ask(plain), ask(by_path)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    for ask in (graph.reference_counts, lambda c: graph.resolve(c.nodes, c.objects), lambda c: formats._top(c, ["Type"]).join(c.streams, formats.KEY)):
        plan = ask(by_path)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    joins_as_given(spark)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == spark.conf.get("spark.sql.unionOutputPartitioning") == "true"


def test_digests_tell_pixels_that_are_not_as_drawn():
    import hashlib

    import pyarrow as pa

    from quire.plans.queries import _as_drawn, _beyond_one

    drawn = bytes([0x0F, 0xFF, 0x01])
    of = lambda byte: hashlib.md5(bytes(255 * (byte >> (7 - i) & 1) for i in range(8))).hexdigest()
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * 5), pa.array([4, 5, 7, 7, 4], pa.int32()), pa.array([1] * 5, pa.int32()), pa.array([of(0x0F), of(0xFF), of(1), of(3), None]), pa.array([drawn] * 5)], names=["doc_id", "obj_num", "height", "seen", "drawn"])
    assert next(_as_drawn([batch])).column("as_drawn").to_pylist() == [True, True, True, False, None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([b"\x00\xff\x07", b"\x05", None, b""], pa.binary()), pa.array([b"\x01\xfd\x07", b"\x05\x05", b"a", b""], pa.binary())], names=["doc_id", "seen", "drawn"])
    assert next(_beyond_one([batch])).to_pydict() == {"doc_id": [1, 2, 3, 4], "n_pixels": [3, 2, None, 0], "n_beyond_one": [1, 1, None, 0]}
