"""Registered queries do the operators' whole job: on small landed tables, with results known beforehand."""

from corpuslens.plans import catalogue


def landed(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def test_pools_of_three_joint_papers(spark, tmp_path):
    """Suppliers 1, 2 and 3 share three orders; 4 and 5 share two."""
    rows = [(o, s) for o in (1, 2, 3) for s in (1, 2, 3)] + [(o, s) for o in (4, 5) for s in (4, 5)] + [(6, 1)]
    d = landed(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_suppkey long")
    assert [tuple(r) for r in catalogue.QUERIES["author_pools"](spark, d).collect()] == [(1, 3, 4, 1.0)]


def test_whole_vocabulary(spark, tmp_path):
    """Documents 1 and 2 share 3 100 rare words: beyond the commonest 500, and for methods 3 000 of them count."""
    common, rare = " ".join(f"common{i:03}" for i in range(400)), [f"rare{i:04}" for i in range(3100)]
    rows = [(1, f"{common} {' '.join(rare)}"), (2, f"{common} {' '.join(reversed(rare))}"), *((i, common) for i in range(3, 7))]
    d = landed(spark, tmp_path, "documents", rows, "doc_id long, text string")
    found = catalogue.QUERIES["tfidf_weights"](spark, d).where("doc = 1").collect()
    assert {r.term for r in found} >= set(rare) and len(found) == 400 + 399 + 3100
    got = {r.doc: r for r in catalogue.QUERIES["similarity_features"](spark, d).collect()}
    assert (got[1].n_high, got[3].n_high, got[1].nearest) == (1, 3, 2)
    assert {(r.doc, r.cluster) for r in catalogue.QUERIES["similarity_clusters"](spark, d).collect()} == {(i, 3) for i in range(3, 7)}
    methods = {r.pmcid: r.methods_n_high for r in catalogue.QUERIES["methods_similarity"](spark, d).collect()}
    assert (methods["PMC1"], methods["PMC3"]) == (1, 3)
    matrix = {r.paper_id: r.n_high for r in catalogue.QUERIES["feature_matrix"](spark, d).collect()}
    assert (matrix[1], matrix[3]) == (1, 3)
