"""Near copies write their sets and prefixes once."""

from stylotrace.llm import jaccard


def test_sets_and_prefixes_are_dealt_once(spark, monkeypatch):
    """Compared sets and shared prefixes are used where they were dealt; results are those of all pairs."""
    words = [f"w{k}" for k in range(400)]
    texts = {k: " ".join(words[10 * k : 10 * k + 60]) for k in range(20)}
    near = {100 + k: t + " extra" for k, t in texts.items()}
    docs = spark.createDataFrame(sorted((texts | near | {300: None}).items()), "doc_id long, text string")
    purposes, plain = [], jaccard.stored

    def recorded(df, purpose):
        purposes.append(purpose)
        if purpose == "buckets":
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(token") == 1
        return plain(df, purpose)

    monkeypatch.setattr(jaccard, "stored", recorded)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs).collect()}
    assert got == {k: k % 100 if k < 300 else 300 for k in got} and len(got) == 41
    assert "buckets" in purposes and not {"compared", "shared"} & set(purposes)
