"""Edits of materials in batch and by stream, and corrections replayed from their log."""

from pyspark.sql import functions as F

from lorespark.operators import corrections, materials
from lorespark.operators.study import ANALYSIS_VERSION, refreshed_points
from lorespark.sources.tables import settled
from lorespark.streaming.materials import read_version, refresh_by_edits, start_store
from tests.test_study import learnt

FIRST, SECOND, THIRD = "가나다는 마바사를 아자차하는 기능을 한다.", "고구려는 압록강 유역에서 건국된 나라이다.", "신라는 경주를 수도로 삼은 나라이다."
EDITS = "material_id long, title string, text string, at long, seq int"


def table(spark):
    rows = [(m, 1, f"t{m}", text, text, 5) for m, text in ((1, FIRST), (2, SECOND), (3, THIRD))]
    made = spark.createDataFrame(rows, "material_id long, unit_id int, title string, raw_text string, final_text string, updated_at long")
    return made.withColumns({"points_hash": F.lit(None).cast("string"), "points_origin": F.lit("local"), "points_version": F.lit(ANALYSIS_VERSION)})


def test_edits(spark):
    edits = spark.createDataFrame([(1, " new ", SECOND, 7, 0), (1, None, THIRD, 7, 1), (2, "late", FIRST, 4, 0), (9, "x", "x", 9, 0)], EDITS)
    rows = {r.material_id: r for r in materials.edited_materials(table(spark), edits).collect()}
    assert (rows[1].title, rows[1].final_text, rows[1].raw_text, rows[1].updated_at) == ("t1", THIRD, FIRST, 7)
    assert (rows[2].title, rows[2].final_text) == ("t2", SECOND) and set(rows) == {1, 2, 3}


def test_structures_are_read_anew(spark):
    m = table(spark).withColumn("final_text", F.when(F.col("material_id") == 1, "[질문] Q1. 왜?\n[핵심 내용]\n본문").when(F.col("material_id") == 2, "Q2. 전에 있던 것?").otherwise(F.col("final_text")))
    pages = spark.createDataFrame([(2, 1, "전에 있던 것?", "쪽 3", ["줄"])], "doc_id long, page int, question string, page_label string, unverified array<string>")
    nodes, found = materials.synced_structures(m, pages)
    assert {(r.doc_id, r.kind) for r in nodes.collect()} == {(1, "question"), (1, "content"), (2, "question")}
    assert {(r.doc_id, r.page_label, tuple(r.unverified)) for r in found.collect()} == {(1, None, ()), (2, "쪽 3", ("줄",))}


def test_stream_of_edits_equals_batches(spark, tmp_path):
    edits = [[(1, None, FIRST + "\n" + SECOND, 10, 0), (2, "two", SECOND + "!", 11, 0)], [(3, "three", FIRST, 12, 0), (1, None, SECOND, 13, 0), (1, None, THIRD, 12, 1)]]
    now, store = F.lit(77).cast("long"), f"{tmp_path}/store"
    points, marked = refreshed_points(table(spark).withColumnRenamed("final_text", "text"), learnt(spark, [(1, FIRST)]), now=F.lit(1).cast("long"))
    first = table(spark).drop("points_hash", "points_origin", "points_version").join(marked.select("material_id", "points_hash", "points_origin", "points_version"), "material_id").select(*table(spark).columns)
    start_store(first, points, store)
    for part in edits:
        spark.createDataFrame(part, EDITS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = refresh_by_edits(stream, store, now).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(200)
    current = read_version(spark, store, -1)
    for number, part in enumerate(edits):
        current = tuple(map(settled, materials.refreshed_after_edits(*current, spark.createDataFrame(part, EDITS), now)))
        for got, want in zip(read_version(spark, store, number), current, strict=True):
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    by = {(r.material_id, r.text): r for r in current[1].collect()}
    assert {r.final_text for r in current[0].where("material_id = 1").collect()} == {SECOND} and (3, FIRST) in by and by[3, FIRST].updated_at == 77
    untouched = read_version(spark, store, 0)[1].where("material_id = 3").first()
    assert untouched.text == THIRD and untouched.updated_at == 1


def test_corrections_are_replayed(spark):
    pages = spark.createDataFrame([(1, 1, "데한민국의 수토는 서울이다. l392년에 데한민국이 섰다."), (1, 2, "글")], "group_id int, page int, text string")
    replies = spark.createDataFrame([(1, True, None)], "group_id int, configured boolean, error string")
    changes = spark.createDataFrame([(1, 0, 1, "데한민국", "대한민국", "high", ""), (1, 1, 1, "수토는", "수도는", "low", ""), (1, 2, 1, "l392년", "1392년", "high", ""), (1, 3, 1, "데한민국", "대한민국", "high", ""), (1, 4, 1, "섰다", "섰 다", "low", ""), (1, 5, 1, "서울이다", "서울과 부산과 대구이다", "high", "")], "group_id int, ord int, page int, raw string, corrected string, confidence string, reason string")
    made = settled(corrections.corrected_pages(pages, replies, changes))
    decisions = spark.createDataFrame([(1, 1, 1, True, 5), (1, 1, 1, False, 6), (1, 1, 5, True, 7)], "group_id int, page int, ord int, accept boolean, seq int")
    events = settled(materials.correction_events(made, decisions))
    assert [r.tag for r in events.orderBy("seq").collect()] == ["applied", "uncertain", "applied", "applied", "applied", "rejected", "confirmed"]
    final = {r.page: r.final for r in made.collect()}
    at = lambda condition: {r.page: r.text for r in materials.replayed_pages(pages, events, condition).collect()}
    assert at(F.col("tag") == "applied") == final
    assert at(None)[1] == final[1].replace("수토는", "수도는") and at(None)[2] == "글"
    assert at(F.col("seq") <= 1)[1] == "대한민국의 수토는 서울이다. l392년에 데한민국이 섰다." and at(F.col("seq") < 1)[1] == pages.first().text
