from cases import documents, empty, odd, prose

from propwell.llm import decontamination as d

ITEM = "Yesterday Alice bought 12 apples from the market and gave 5 to her brother Bob so that Alice kept the rest for later."


def flagged(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, "doc_id", "text", benchmark, "item_id", "text").collect()}


def test_changed_values_are_found(spark):
    changed = "Intro here. " + ITEM.replace("Alice", "Carla").replace("Bob", "Dan").replace("12", "99").replace("5", "7.5") + " More."
    assert flagged(spark, [ITEM, changed, ITEM.upper(), prose(1, 200), "", None]) == {(0, 1), (1, 1), (2, 1)} - {(2, 1)}


def test_slots_must_agree(spark):
    mixed = ITEM.replace("Alice kept", "Eve kept").replace("Alice bought", "Carla bought")
    assert flagged(spark, [mixed]) == set()


def test_units_are_typed(spark):
    item = "the box weighs 12 kg and the other box weighs 30 kg when both are filled with sand"
    other = item.replace("kg", "pounds").replace("12", "40").replace("30", "9")
    assert flagged(spark, [other, item.replace("12 kg", "12 blue")], [(1, item)]) == {(0, 1)}


def test_lookup_set_changes_nothing(spark, monkeypatch):
    texts = [ITEM, prose(2, 100), "x " + ITEM]
    with_set = flagged(spark, texts)
    monkeypatch.setattr(d, "MOST_LITERAL", 0)
    assert flagged(spark, texts) == with_set == {(0, 1), (2, 1)}


def test_short_and_empty(spark):
    benchmark = spark.createDataFrame([(1, "too short"), (2, None), (None, ITEM)], "item_id bigint, text string")
    got = d.contaminated(odd(spark), "doc_id", "text", benchmark, "item_id", "text")
    assert got.count() == 0
    assert d.contaminated(empty(spark), "doc_id", "text", benchmark, "item_id", "text").count() == 0
    assert d.contaminated(odd(spark), "doc_id", "text", benchmark.limit(0), "item_id", "text").count() == 0


def test_documents_that_hold_an_item(spark):
    sf_dir = "/root/testdata/sf0.001"
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    whole = {i for i, t in documents(spark) if any(x in t for x in items)}
    got = d.op4_decontamination(spark, sf_dir).collect()
    assert len(got) == len(documents(spark))
    assert whole <= {r["doc_id"] for r in got if r["contaminated"]}


def leaking(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(items), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in d.leaks(docs, "doc_id", "text", benchmark, "item_id", "text").collect()}


def test_case_hides_no_copy(spark):
    texts = [ITEM, ITEM.upper(), "x " + ITEM.lower(), ITEM.replace("Alice", "Carla"), prose(1, 200), None]
    assert leaking(spark, texts) == {(0, 1), (1, 1), (2, 1), (3, 1)}
    german = "Die Straße von Hamburg nach Berlin führt durch viele Dörfer und Wälder mit alten Häusern am Rand"
    assert leaking(spark, [german.upper()], [(1, german)]) == {(0, 1)}


def test_short_items_are_found_whole(spark):
    items = [(1, "12 + 30 = ?"), (2, "Who wrote Faust?"), (3, None), (4, "")]
    texts = ["Sums: 12 + 30 = ? Well.", "12 - 30 = ?", "so WHO WROTE FAUST? he asked", "who wrote it", None]
    assert leaking(spark, texts, items) == {(0, 1), (2, 2)}


def test_long_quotation_of_a_longer_item(spark):
    item = prose(11, 59)
    words = item.split()
    assert leaking(spark, ["a b c " + " ".join(words[10:35]) + " d e f", " ".join(words[10:22])], [(1, item)]) == {(0, 1)}


def test_conflict_costs_its_windows_only(spark):
    item = "so there were 4 apples in the first old basket near the green door of the long house and the man who lived there put 4 pears beside it"
    redrawn = item.replace("4 apples", "3 apples").replace("4 pears", "5 pears").replace("so there", "now there")
    assert flagged(spark, [redrawn], [(1, item)]) == set()
    assert leaking(spark, [redrawn], [(1, item)]) == {(0, 1)}
    assert leaking(spark, [ITEM.replace("Alice kept", "Eve kept").replace("Alice bought", "Carla bought")]) == set()
