"""Clustering, projection, profiles and pricing against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import customer_rows
from keepwise.operators import kmeans as km
from keepwise.operators import pricing as pc
from keepwise.operators import segments as sg
from keepwise.schema import ID, PRICE_FEATURES, SIMPLE_FEATURES, TARGET


@pytest.fixture(scope="module")
def vectors(raw):
    return sg.cluster_vectors(raw).cache()


def matrix(vectors):
    rows = vectors.orderBy(ID).select(vector_to_array("features")).collect()
    return np.array([r[0] for r in rows])


def test_simple_vectors_are_standardised(raw):
    x = matrix(sg.cluster_vectors(raw, SIMPLE_FEATURES))
    assert x.shape == (60, 3)
    assert np.abs(x.mean(0)).max() < 1e-9 and np.abs(x.std(0) - 1).max() < 1e-9


def brute_silhouette(x, labels):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    out = []
    for i, own in enumerate(labels):
        same = [j for j, c in enumerate(labels) if c == own and j != i]
        if not same:
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == c].mean() for c in set(labels) if c != own)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_scores_per_k(vectors):
    scores = sg.kmeans_scores(vectors, [2, 3, 4], starts=3).collect()
    inertia = [r["inertia"] for r in scores]
    assert [r["k"] for r in scores] == [2, 3, 4] and inertia == sorted(inertia, reverse=True)
    model = sg.best_kmeans(vectors, [3], starts=3)[3]
    labelled = model.label(vectors, "c").orderBy(ID).collect()
    labels = np.array([r["c"] for r in labelled])
    assert scores[1]["silhouette"] == pytest.approx(brute_silhouette(matrix(vectors), labels))
    with pytest.raises(ValueError, match="too few"):
        sg.kmeans_scores(vectors.limit(2), [2])
    with pytest.raises(ValueError, match="at least 2"):
        sg.fit_segments(vectors, 1)


def test_rows_stay_packed_in_blocks(spark, vectors):
    """A pass reads one entry a block, not one a row, and adds up what plain numpy does."""
    x, rng = matrix(vectors), np.random.default_rng(1)
    runs = {0: x[rng.permutation(len(x))[:3]], 1: x[rng.permutation(len(x))[:5]]}
    with km.Rows(vectors, ID, "features") as rows:
        assert rows.df.count() <= vectors.rdd.getNumPartitions() and rows.n == len(x)
        found = rows.sums(runs)
    for r, centres in runs.items():
        d = ((x[:, None, :] - centres) ** 2).sum(-1)
        own = d.argmin(1)
        assert found[r].cost == pytest.approx(d.min(1).sum()) and found[r].counts.tolist() == np.bincount(own, minlength=len(centres)).tolist()
        assert found[r].sums == pytest.approx(np.stack([x[own == c].sum(0) for c in range(len(centres))]))
        assert found[r].squares == pytest.approx(np.array([(x[own == c] ** 2).sum() for c in range(len(centres))]))


def test_runs_end_at_means_of_their_rows(vectors):
    x = matrix(vectors)
    found = sg.best_kmeans(vectors, [2, 5], starts=4)
    again = sg.best_kmeans(vectors.repartition(7), [5, 2], starts=4)
    for k in (2, 5):
        centres = found[k].centres
        assert centres.shape == (k, x.shape[1]) and np.allclose(centres, again[k].centres)
        d = ((x[:, None, :] - centres[None]) ** 2).sum(-1)
        own = d.argmin(1)
        assert found[k].cost == pytest.approx(d.min(1).sum()) and found[k].counts.tolist() == np.bincount(own, minlength=k).tolist()
        shift = sum(((x[own == c].mean(0) - centres[c]) ** 2).sum() for c in range(k))
        assert shift <= 1e-4 * x.var(0, ddof=1).mean()
    # A clustering no single row can improve is not far from any random restart.
    best = min(lloyd(x, x[np.random.default_rng(s).choice(len(x), 2, replace=False)]) for s in range(30))
    assert found[2].cost <= 1.05 * best


def lloyd(x, centres):
    for _ in range(50):
        own = ((x[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return ((x[:, None, :] - centres[None]) ** 2).sum(-1).min(1).sum()


def test_copies_are_clustered(spark, vectors):
    same = vectors.limit(1).select("features").crossJoin(spark.range(6)).selectExpr("cast(id as string) as customerID", "features")
    found = sg.best_kmeans(same, [3], starts=2)[3]
    assert found.cost == pytest.approx(0, abs=1e-9) and found.counts.tolist() == [6, 0, 0]
    assert sg.kmeans_scores(same, [3], starts=2).first()["silhouette"] is None


def test_segments_and_projection(raw, vectors):
    found, explained = sg.fit_segments(vectors, 3, starts=3)
    rows = found.orderBy(ID).collect()
    assert {r["segment"] for r in rows} == {0, 1, 2}
    again = sg.fit_segments(vectors, 3, starts=3)[0].orderBy(ID).collect()
    assert [r["segment"] for r in rows] == [r["segment"] for r in again]
    x = matrix(vectors)
    x = x - x.mean(0)
    _, s, axes = np.linalg.svd(x, full_matrices=False)
    assert explained == pytest.approx(list((s**2 / (s**2).sum())[:2]))
    for i, name in enumerate(("pc1", "pc2")):
        axis = axes[i] * np.sign(axes[i][np.abs(axes[i]).argmax()])
        assert [r[name] for r in rows] == pytest.approx(list(x @ axis))
    assert found.columns == [*raw.columns, "segment", "pc1", "pc2"]
    profiles = sg.segment_profiles(found)
    assert sum(r["antal_kunder"] for r in profiles.collect()) == 60
    best = sg.extreme_segments(profiles).first()
    assert best["riskiest_churn"] >= best["safest_churn"]
    assert "churn_andel" not in sg.segment_profiles(found.drop(TARGET)).columns


def test_profile_values(make):
    rows = [dict(r) for r in customer_rows(5)]
    for r, contract in zip(rows, ["Two year", "One year", "One year", "Two year", None], strict=True):
        r["Contract"] = contract
    for r, left in zip(rows, ["No", "Yes", "No", "Yes", "No"], strict=True):
        r[TARGET] = left
    one = sg.segment_profiles(make(rows).withColumn("segment", F.lit(0))).first()
    assert one["vanligaste_avtal"] == "One year" and one["antal_kunder"] == 5
    assert one["churn_andel"] == 0.4


def test_price_model_is_minimum_norm_least_squares(spark, raw):
    data = pc.pricing_data(raw)
    rows = data.orderBy(ID).collect()
    assert all(r["InternetService"] != "No" for r in rows)
    names = sorted({(c, r[c]) for r in rows for c in PRICE_FEATURES})
    x = np.array([[float(r[c] == level) for c, level in names] for r in rows])
    y = np.array([r["MonthlyCharges"] for r in rows])
    beta = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    model = pc.fit_price_model(data)
    assert [model.coefficients[n] for n in names] == pytest.approx(list(beta), abs=1e-6)
    predicted = [r["p"] for r in data.withColumn("p", model.price()).orderBy(ID).collect()]
    assert predicted == pytest.approx(list((x - x.mean(0)) @ beta + y.mean()))
    spans = {r["tjanst"]: r["USD_per_manad"] for r in pc.price_list(spark, model).collect()}
    assert set(spans) == set(PRICE_FEATURES) and min(spans.values()) >= 0
    pairs = {(r["a"], r["b"]): r["n"] for r in pc.gramian(pc.bundles(data)).collect()}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert pairs.get(("_".join(a), "_".join(b)), 0) == (x[:, i] * x[:, j]).sum()


def test_unknown_internet_service_is_kept(make):
    rows = customer_rows()
    rows[0]["InternetService"] = None
    assert pc.pricing_data(make(rows)).filter("InternetService is null").count() == 1
    with pytest.raises(KeyError):
        pc.pricing_data(make(rows).drop("InternetService"))


def test_additive_prices_are_recovered(spark, raw):
    added = F.when(F.col("StreamingTV") == "Yes", 10.0).otherwise(0.0)
    base = F.when(F.col("InternetService") == "DSL", 25.0).otherwise(50.0)
    data = pc.pricing_data(raw.withColumn("MonthlyCharges", base + added))
    model, r2 = pc.train_price_model(data)
    assert r2.first()[0] == pytest.approx(1.0)
    quotes = pc.price_quotes(raw.withColumn("expected", base + added), model, data)
    online = quotes.filter("InternetService <> 'No'").collect()
    assert [r["manadspris"] for r in online] == pytest.approx([r["expected"] for r in online])
    assert not any(r["extrapolated"] for r in online)
    assert all(r["extrapolated"] for r in quotes.filter("InternetService = 'No'").collect())
