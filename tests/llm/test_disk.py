from loomspark.llm import jaccard, quality
from loomspark.llm._store import scope


def docs(spark):
    words = [" ".join(f"w{(i * j) % 97}" for j in range(1, 60)) for i in range(1, 30)]
    rows = [(i, w) for i, w in enumerate(words + [w + " more" for w in words])] + [(90, None), (91, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_signatures_go_before_links_are_made(spark):
    with scope(spark) as made:
        found = jaccard.shingle_components(docs(spark), size=3, part=80)
        assert made and not [p for p in made if "/profiles-" in p]
        one = sorted(map(tuple, found.select("doc_id", "component_id").collect()))
    assert {(29 + i, i) for i in range(29)} <= set(one) and (90, 90) in one and (91, 91) in one


def test_only_its_result_stays_of_near_copies(spark):
    with scope(spark) as made:
        assert jaccard.without_copies(docs(spark), size=3, part=80).count() == 31
        assert {p.rsplit("/", 1)[1].split("-")[0] for p in made} <= {"copies", "bits"}


def test_texts_are_sent_once_to_be_judged(spark):
    """Plain texts and nulls are judged as they stand in their own column."""
    df = docs(spark)
    kept = quality.keep_good(df, quality.no_labels())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in df.collect())
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(text" not in plan
