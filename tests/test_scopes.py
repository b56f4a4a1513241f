"""Sums over what users see equal sums over the pairs."""

import random

from pyspark.sql import functions as F

from paperledger.operators import store


def test_totals_of_visible_documents(spark):
    r = random.Random(9)
    users = spark.createDataFrame([(k, r.choice(["admin", "operator", "accountant", "client"]), r.choice([None, 1, 2, 3])) for k in range(60)], "id bigint, role string, company_id bigint")
    docs = spark.createDataFrame([(k, r.randrange(60), r.choice([None, 1, 2, 3, 4])) for k in range(300)], "id bigint, owner_id bigint, company_id bigint")
    links = spark.createDataFrame([(r.choice([1, 2, 3, 4]), r.randrange(60)) for _ in range(40)], "company_id bigint, user_id bigint").distinct()
    pairs = store.visible_documents(users, docs, links).groupBy("user_id").agg(F.count(F.lit(1)), F.coalesce(F.sum("document_id"), F.lit(0)))
    want = sorted(map(tuple, pairs.collect()))
    assert len(want) > 40 and sorted(map(tuple, store.visible_totals(users, docs, links).collect())) == want
    assert store.visible_totals(users.limit(0), docs, links).collect() == [] == store.visible_totals(users.where("role = 'client'"), docs.limit(0), links).collect()
