"""Queries: neighbours, classifiers and sweeps, wide tables."""

from __future__ import annotations

from functools import cached_property, reduce
from itertools import combinations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import estimators as est
from ..operators import evaluate as ev
from ..operators import linear as lin
from ..operators import neighbors as nn
from ..operators import temporal as tmp
from ..operators import boosting as boost
from ..operators import discover as dis
from ..operators import patterns as pat
from ..operators import solvers as sol
from ..session import stage
from ..sources.records import select_features
from . import fixtures as fx
from .catalog import query
from .oracle import cte, with_ctes
from .study import K, Study

KS = est.NEIGHBOR_COUNTS
LAYOUT_STEPS = 50
# The study's own counts, and those of the reference that the encoder's features allow.
SWEEP_COUNTS = sorted({n for n in (1, 2, 4, K) if n <= K} | {n for n in est.FEATURE_COUNTS if n <= fx.D_SAE})


class Vectors(Study):
    """The study with its train and test vectors."""

    @cached_property
    def train_vectors(self):
        return stage(est.vector_table(self.picks(self.train_first), self.train, self.ids))

    @cached_property
    def test_vectors(self):
        return stage(est.vector_table(self.picks(self.test_first), self.test, self.ids))

    @cached_property
    def n_train(self) -> int:
        return self.train_vectors.count()

    def sweep(self, configs):
        return est.run_sweep(self.train_vectors, self.test_vectors, configs)

    @cached_property
    def train_patterns(self):
        return stage(pat.patterns(self.train_vectors, self.classes))

    @cached_property
    def test_patterns(self):
        return stage(pat.patterns(self.test_vectors, self.classes))

    def fits(self, fits):
        """The fits' results, computed once."""
        return stage(pat.run_fits(self.train_patterns, self.test_patterns, fits))

    def svm_fits(self, cs, rbf):
        """One task for each C and pair of classes."""
        pairs = list(combinations(range(len(self.classes)), 2))
        name = "SVM RBF" if rbf else "SVM linear"
        return [pat.Fit(f"{name} C={c:g}", sol.pair_svm, {"pair": pair, "c": c, "rbf": rbf}, part)
                for c in cs for part, pair in enumerate(pairs)]

    def scored(self, results, params):
        """Result rows as `run_sweep` returns them; `params` gives those of each configuration."""
        one = F.when(F.lit(False), F.lit(None).cast("map<string,string>"))
        for name, values in params.items():
            entries = [F.lit(str(x)) for pair in values.items() for x in pair]
            one = one.when(F.col("config") == name, F.create_map(*entries) if entries else F.create_map().cast("map<string,string>"))
        return pat.accuracies(results).select(F.lit("main").alias("dataset"), "config", one.alias("params"), "accuracy", "n_test")


#: The distinct vectors of the training rows, and each class's rows among them.
cte("train_patterns", ("picks", "train"), """
  SELECT label, x, count(*) AS n FROM (
    SELECT t.sample_id, t.label, coalesce(string_agg(p.feature_id::VARCHAR, ',' ORDER BY p.feature_id), '') AS x
    FROM train t LEFT JOIN picks p USING (sample_id) GROUP BY t.sample_id, t.label)
  GROUP BY label, x""")


def _whole_sql(configs, flag, more="", also=""):
    """Rows and distinct vectors of the training set, once for each configuration."""
    names = ", ".join(f"('{c}')" for c in configs)
    return with_ctes("train_patterns samples", f"""
      SELECT c.config, t.n_rows, t.n_patterns, true AS {flag}{more}
      FROM (VALUES {names}) c(config) CROSS JOIN (
        SELECT sum(n)::BIGINT AS n_rows, count(DISTINCT x) AS n_patterns FROM train_patterns) t{also}""")


def _pairs_sql(name, cs):
    """Of each C and pair of classes: its rows, its distinct vectors, and that the fit is at its optimum."""
    names = ", ".join(f"('{name} C={c:g}')" for c in cs)
    return with_ctes("train_patterns samples", f"""
      SELECT c.config, a.label AS class_a, b.label AS class_b, coalesce(t.n_rows, 0)::BIGINT AS n_rows,
        coalesce(t.n_patterns, 0)::BIGINT AS n_patterns, true AS converged
      FROM (VALUES {names}) c(config)
      CROSS JOIN (SELECT DISTINCT label FROM samples) a JOIN (SELECT DISTINCT label FROM samples) b ON a.label < b.label
      LEFT JOIN (
        SELECT a.label AS la, b.label AS lb, sum(p.n) AS n_rows, count(DISTINCT p.x) AS n_patterns
        FROM (SELECT DISTINCT label FROM samples) a JOIN (SELECT DISTINCT label FROM samples) b ON a.label < b.label
        JOIN train_patterns p ON p.label IN (a.label, b.label) GROUP BY a.label, b.label) t
        ON t.la = a.label AND t.lb = b.label""")


#: Most that the primal may exceed the dual by, as a share of the primal.
GAP = 1e-3


def _pair_facts(s, cs, rbf):
    """Facts of each machine, from the tasks that fitted it."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(s.classes, 2)])
    rows = pat.facts(s.fits(s.svm_fits(cs, rbf))).withColumn("_p", F.get(pairs, F.col("part")))
    return rows.select(
        "config", F.col("_p.a").alias("class_a"), F.col("_p.b").alias("class_b"),
        F.col("facts")["n_rows"].cast("long").alias("n_rows"), F.col("facts")["n_patterns"].cast("long").alias("n_patterns"),
        (F.col("facts")["gap"] <= GAP).alias("converged"))


cte("knn_pairs", ("picks", "train", "test"), """
  SELECT t.sample_id, t.label, r.sample_id AS train_id, r.label AS train_label,
    row_number() OVER (PARTITION BY t.sample_id ORDER BY
      coalesce(a.n, 0) + coalesce(b.n, 0) - 2 * coalesce(c.n, 0), r.sample_id) AS rank
  FROM test t CROSS JOIN train r
  LEFT JOIN (SELECT sample_id, count(*) AS n FROM picks GROUP BY sample_id) a ON a.sample_id = t.sample_id
  LEFT JOIN (SELECT sample_id, count(*) AS n FROM picks GROUP BY sample_id) b ON b.sample_id = r.sample_id
  LEFT JOIN (SELECT x.sample_id AS l, y.sample_id AS r, count(*) AS n FROM picks x JOIN picks y USING (feature_id)
             GROUP BY x.sample_id, y.sample_id) c ON c.l = t.sample_id AND c.r = r.sample_id""")


@query("c06_nearest_neighbors", with_ctes("knn_pairs", """
  SELECT sample_id, label, k, CAST(arg_min(train_label, (-n, train_label)) AS INTEGER) AS pred FROM (
    SELECT p.sample_id, p.label, g.k::INTEGER AS k, p.train_label, count(*) AS n
    FROM knn_pairs p JOIN (VALUES (1), (3), (5), (11)) g(k) ON p.rank <= g.k
    GROUP BY p.sample_id, p.label, g.k, p.train_label)
  GROUP BY sample_id, label, k"""))
def c06(spark, sf_dir):
    return _neighbor_votes(Study(spark, sf_dir))


def _neighbor_votes(s):
    train = stage(nn.packed_vectors(s.picks(s.train_first), s.train, s.ids))
    test = stage(nn.packed_vectors(s.picks(s.test_first), s.test, s.ids))
    return nn.vote(nn.nearest_neighbors(train, test, max(KS)), test, KS)


cte("all_bits", ("first_fire", "alive"), """
  SELECT a.sample_id, a.label, coalesce(bit_or(1::HUGEINT << (f.layer * 32 + f.feature_id)), 0::HUGEINT) AS bits
  FROM alive a LEFT JOIN first_fire f USING (sample_id) GROUP BY a.sample_id, a.label""")
cte("all_bits_near", ("all_bits", "train", "test"), """
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM (
    SELECT a.sample_id, b.sample_id AS neighbor_id, b.label AS neighbor_label,
      bit_count(xor(a.bits, b.bits))::INTEGER AS distance
    FROM all_bits a JOIN test USING (sample_id) CROSS JOIN (
      SELECT x.* FROM all_bits x JOIN train t ON t.sample_id = x.sample_id) b)""")


@query("c06_indexed_neighbors", with_ctes("all_bits_near", """
  SELECT sample_id, neighbor_id, neighbor_label, distance, rank
  FROM all_bits_near WHERE rank <= 5"""))
def c06_indexed(spark, sf_dir):
    """Five neighbours by the firings of all features of all layers, through the index over parts of the bits."""
    s = Study(spark, sf_dir)
    codes = s.first.withColumn("feature_id", F.col("layer") * fx.D_SAE + F.col("feature_id"))
    n_bits = fx.N_LAYERS * fx.D_SAE
    bits = stage(nn.packed_vectors(codes, s.alive, range(n_bits)))
    train, test = stage(s.part(bits, "train")), stage(s.part(bits, "test"))
    near, _ = nn.indexed_neighbors(train, test, 5, n_bits)
    return near


@query("s03_feature_columns", with_ctes("picks alive", """
  SELECT s.sample_id, s.label, """ + ", ".join(
    f"coalesce(max(CASE WHEN p.rank = {i} THEN 1.0 END), 0.0)::FLOAT AS f{i}" for i in range(1, 5)) + """
  FROM alive s LEFT JOIN picks p USING (sample_id) GROUP BY s.sample_id, s.label"""))
def s03(spark, sf_dir):
    """The first four feature columns of the wide table, in file order."""
    s = Study(spark, sf_dir)
    wide = dis.feature_table(s.first, s.alive, s.chosen, s.ids)
    cut, names, _ = select_features(wide, 4)
    return cut.select("sample_id", "label", *[F.col(c).alias(f"f{i + 1}") for i, c in enumerate(names)])


EPOCHS = 30


def _epoch_losses(results):
    """(config, epoch, loss) of the networks among the fits."""
    rows = pat.facts(results).select("config", F.explode("facts").alias("fact", "loss"))
    return rows.where(F.col("fact").startswith("loss ")).select(
        "config", F.substring("fact", 6, 3).cast("int").alias("epoch"), "loss")


@query("c01_perceptron_loss")
def c01(spark, sf_dir):
    """The loss of every epoch of a network with one hidden layer of 64."""
    s = Vectors(spark, sf_dir)
    return _epoch_losses(s.fits([pat.Fit("MLP 64", sol.network, {"epochs": EPOCHS})])).select(
        F.col("epoch").alias("iteration"), "loss")


@query("c01_network_training", with_ctes("train", f"""
  SELECT 'MLP 64' AS config, {EPOCHS} AS epochs, count(*) AS n_rows, true AS loss_fell FROM train"""))
def c01_training(spark, sf_dir):
    """How long the network was trained, on how many rows, and that its loss fell."""
    s = Vectors(spark, sf_dir)
    ends = _epoch_losses(s.fits([pat.Fit("MLP 64", sol.network, {"epochs": EPOCHS})])).groupBy("config").agg(
        F.count(F.lit(1)).cast("int").alias("epochs"),
        (F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).alias("loss_fell"))
    rows = s.train_patterns.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n_rows"))
    return ends.withColumn("_one", F.lit(1)).join(F.broadcast(rows.withColumn("_one", F.lit(1))), "_one").drop("_one")


@query("c03_logistic")
def c03(spark, sf_dir):
    s = Vectors(spark, sf_dir)
    return s.sweep([est.Config(f"LogReg C={c:g}", est.logistic(c, s.n_train), {"C": c}) for c in est.LOGISTIC_C])


@query("c04_linear_svm")
def c04(spark, sf_dir):
    return _svm_sweep(Vectors(spark, sf_dir), est.LINEAR_SVM_C, False)


@query("c05_rbf_svm")
def c05(spark, sf_dir):
    return _svm_sweep(Vectors(spark, sf_dir), est.RBF_SVM_C, True)


def _svm_sweep(s, cs, rbf):
    fits = s.svm_fits(cs, rbf)
    return s.scored(s.fits(fits), {f.config: {"C": f.params["c"]} for f in fits})


@query("c04_svm_pairs", _pairs_sql("SVM linear", est.LINEAR_SVM_C))
def c04_pairs(spark, sf_dir):
    """Each linear machine of two classes: what it was fitted on, and that its duality gap is closed."""
    return _pair_facts(Vectors(spark, sf_dir), est.LINEAR_SVM_C, False)


@query("c05_rbf_pairs", _pairs_sql("SVM RBF", est.RBF_SVM_C))
def c05_pairs(spark, sf_dir):
    return _pair_facts(Vectors(spark, sf_dir), est.RBF_SVM_C, True)


def _logistic_fits(cs):
    return [pat.Fit(f"LogReg C={c:g}", sol.logistic, {"c": c}) for c in cs]


def _fit_facts(rows, flag):
    return rows.select(
        "config", F.col("facts")["n_rows"].cast("long").alias("n_rows"),
        F.col("facts")["n_patterns"].cast("long").alias("n_patterns"), flag)


@query("c03_logistic_optimum", _whole_sql([f"LogReg C={c:g}" for c in est.LOGISTIC_C], "at_optimum"))
def c03_optimum(spark, sf_dir):
    """Each logistic model: what it was fitted on, and that its gradient vanishes."""
    s = Vectors(spark, sf_dir)
    rows = pat.facts(s.fits(_logistic_fits(est.LOGISTIC_C)))
    return _fit_facts(rows, (F.col("facts")["gradient"] < sol.GRADIENT).alias("at_optimum"))


@query("c07_random_forest")
def c07(spark, sf_dir):
    s = Vectors(spark, sf_dir)
    return s.sweep([est.Config(f"RandomForest {t}", est.random_forest(t), {"trees": t}) for t in est.FOREST_TREES])


BOOSTED = pat.Fit("GradientBoosting", boost.boosted, {"rounds": est.BOOSTING_ROUNDS})


@query("c08_gradient_boosting")
def c08(spark, sf_dir):
    s = Vectors(spark, sf_dir)
    return s.scored(s.fits([BOOSTED]), {"GradientBoosting": {"rounds": est.BOOSTING_ROUNDS}})


@query("c08_boosting_fit", _whole_sql(["GradientBoosting"], "learnt", f", {est.BOOSTING_ROUNDS} AS rounds"))
def c08_fit(spark, sf_dir):
    """What was fitted, and that its loss is below that of the classes' shares alone."""
    s = Vectors(spark, sf_dir)
    prior = s.train_vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("_t"), F.sum(
        F.col("n") * F.log("n")).alias("_l")).select((F.log("_t") - F.col("_l") / F.col("_t")).alias("prior"))
    rows = pat.facts(s.fits([BOOSTED])).withColumn("_one", F.lit(1)).join(
        F.broadcast(prior.withColumn("_one", F.lit(1))), "_one")
    return _fit_facts(rows, (F.col("facts")["loss"] < F.col("prior")).alias("learnt")).withColumn(
        "rounds", F.lit(est.BOOSTING_ROUNDS))


TREES_A_TASK = 25


def _forest_fits(sizes):
    return [pat.Fit(f"RandomForest {t}", sol.forest, {"trees": (i, min(i + TREES_A_TASK, t))}, i // TREES_A_TASK)
            for t in sizes for i in range(0, t, TREES_A_TASK)]


@query("c10_classifier_comparison")
def c10(spark, sf_dir):
    """All eighteen classifiers on one split, their fits as tasks of one job."""
    s = Vectors(spark, sf_dir)
    votes = _neighbor_votes(s).groupBy("k").agg(
        F.avg(ev.hit()).alias("accuracy"), F.count(F.lit(1)).alias("n_test"))
    near = votes.select(
        F.lit("main").alias("dataset"), F.concat(F.lit("KNN k="), F.col("k").cast("string")).alias("config"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("params"), "accuracy", "n_test")
    fits = [*_logistic_fits(est.LOGISTIC_C), *s.svm_fits(est.LINEAR_SVM_C, False), *s.svm_fits(est.RBF_SVM_C, True),
            *_forest_fits(est.FOREST_TREES), BOOSTED, pat.Fit("BernoulliNB", sol.bernoulli_bayes)]
    params = {f.config: {"C": f.params["c"]} if "c" in f.params else {} for f in fits}
    params |= {f"RandomForest {t}": {"trees": t} for t in est.FOREST_TREES}
    params["GradientBoosting"] = {"rounds": est.BOOSTING_ROUNDS}
    return s.scored(s.fits(fits), params).unionByName(near)


@query("c11_feature_count_logistic")
def c11_logistic(spark, sf_dir):
    """Logistic regression and a two-layer network on the best n features of the study's layer."""
    s = Vectors(spark, sf_dir)
    most = max(SWEEP_COUNTS)
    chosen = dis.discover(s.train_first, s.train, most, fx.D_SAE, layer=s.layer, layers=fx.layer_frame(spark))
    ids = dis.feature_ids_in_order(chosen)
    train, test = (
        stage(est.vector_table(lin.restrict(first, s.layer, ids), samples, ids))
        for first, samples in ((s.train_first, s.train), (s.test_first, s.test)))
    configs = [
        est.Config(f"LogReg top-{n}", est.logistic(1.0, s.n_train), {"n_features": n}, n_features=n) for n in SWEEP_COUNTS]
    configs += [
        est.Config(f"MLP top-{n}", est.perceptron(n, len(s.classes), est.SWEEP_HIDDEN, 0, est.SWEEP_STEPS),
                   {"n_features": n}, n_features=n) for n in SWEEP_COUNTS]
    return est.run_sweep(train, test, configs)


def _layout_fits():
    """All layouts and seeds, those that take longest first."""
    layouts = sorted(est.LAYOUTS, key=lambda h: -est.parameter_count(K, 0, h))
    return [pat.Fit(f"{est.layout_name(h)} seed {seed}", sol.network, {"hidden": h, "seed": seed, "epochs": LAYOUT_STEPS})
            for h in layouts for seed in est.LAYOUT_SEEDS]


@query("c12_layout_sweep")
def c12(spark, sf_dir):
    """All layouts and seeds, with the parameters and the bookkeeping of each layout."""
    s = Vectors(spark, sf_dir)
    fits = _layout_fits()
    results = s.scored(s.fits(fits), {f.config: {"seed": f.params["seed"]} for f in fits})
    return ev.over_seeds(_with_layout(s, results), ["dataset", "config", "n_params"])


def _with_layout(s, rows):
    """`config` without its seed, the seed, and the layout's parameters."""
    n = len(s.classes)
    sizes = F.create_map(*[F.lit(x) for h in est.LAYOUTS for x in (est.layout_name(h), est.parameter_count(K, n, h))])
    name = F.split_part("config", F.lit(" seed "), F.lit(1))
    return rows.withColumns({
        "seed": F.split_part("config", F.lit(" seed "), F.lit(2)).cast("int"), "config": name,
        "n_params": sizes[name].cast("long")})


def _layout_rows():
    """(layout, parameters besides those of the last layer, width before the last layer)."""
    return ", ".join(f"('{est.layout_name(h)}', {est.parameter_count(K, 0, h)}, {(h or (K,))[-1]})" for h in est.LAYOUTS)


@query("c12_layout_training", with_ctes("samples", f"""
  SELECT v.config, (v.inner_params + (v.width + 1) * c.n)::BIGINT AS n_params, {len(est.LAYOUT_SEEDS)}::BIGINT AS n_seeds,
    true AS loss_fell
  FROM (VALUES {_layout_rows()}) v(config, inner_params, width)
  CROSS JOIN (SELECT count(DISTINCT label) AS n FROM samples) c"""))
def c12_training(spark, sf_dir):
    """Each layout's parameters and seeds, and that the loss fell under every seed."""
    s = Vectors(spark, sf_dir)
    ends = _epoch_losses(s.fits(_layout_fits())).groupBy("config").agg(
        (F.max_by("loss", "epoch") < F.min_by("loss", "epoch")).alias("fell"))
    return _with_layout(s, ends).groupBy("config", "n_params").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.every("fell").alias("loss_fell"))


@query("c13_regularisation_logistic")
def c13_logistic(spark, sf_dir):
    s = Vectors(spark, sf_dir)
    configs = []
    for decay in est.WEIGHT_DECAYS:
        fit = est.logistic(1.0, s.n_train).setRegParam(decay)
        configs.append(est.Config(f"wd={decay:g}", fit, {"weight_decay": decay}))
    return s.sweep(configs)


@query("c13_weight_decay_networks")
def c13_networks(spark, sf_dir):
    """Decoupled weight decay of the widest network, over seeds."""
    s = Vectors(spark, sf_dir)
    fits = [pat.Fit(f"wd={d:g} seed {seed}", sol.network,
                    {"hidden": est.SWEEP_HIDDEN, "seed": seed, "epochs": est.SWEEP_STEPS, "decay": d})
            for d in est.WEIGHT_DECAYS for seed in est.LAYOUT_SEEDS]
    results = s.scored(s.fits(fits), {f.config: {"weight_decay": f.params["decay"]} for f in fits})
    return ev.over_seeds(results.withColumns({
        "seed": F.split_part("config", F.lit(" seed "), F.lit(2)).cast("int"),
        "config": F.split_part("config", F.lit(" seed "), F.lit(1))}), ["dataset", "config"])


@query("c15_sweep_runner")
def c15(spark, sf_dir):
    """Both layers as datasets, each with its own chosen features: all fits are tasks of one job."""
    s = Vectors(spark, sf_dir)
    parts = []
    for layer in range(fx.N_LAYERS):
        chosen = dis.discover(s.train_first, s.train, K, fx.D_SAE, layer=layer, layers=fx.layer_frame(spark))
        ids = dis.feature_ids_in_order(chosen)
        parts.append([
            pat.patterns(est.vector_table(lin.restrict(first, layer, ids), samples, ids), s.classes).withColumn(
                "dataset", F.lit(f"layer {layer}"))
            for first, samples in ((s.train_first, s.train), (s.test_first, s.test))])
    train, test = (stage(reduce(DataFrame.unionByName, tables)) for tables in zip(*parts, strict=True))
    fits = [pat.Fit("LogReg C=1", sol.logistic, {"c": 1.0}), pat.Fit("BernoulliNB", sol.bernoulli_bayes)]
    results = stage(pat.run_fits(train, test, fits, ["dataset"]))
    return pat.accuracies(results, ["dataset"]).select(
        "dataset", "config", F.create_map().cast("map<string,string>").alias("params"), "accuracy", "n_test")


@query("d04_logistic_curve")
def d04_logistic(spark, sf_dir):
    """The confidence curve under a logistic model with C = 10."""
    s = Vectors(spark, sf_dir)
    model = est.logistic(10.0, s.n_train).fit(s.train_vectors)
    weights = lin.from_matrix(spark, s.ids, model.coefficientMatrix.toArray(), model.interceptVector.toArray())
    grid = list(range(1, fx.MAX_STEPS + 1))
    return tmp.confidence_curve(s.picks(s.test_first), s.test, weights, s.classes, grid)


SNAPSHOT_C = 10.0


def _snapshot_patterns(s, first, samples):
    """Pattern tables of all snapshots: the features that fired before t."""
    grid = F.array(*[F.lit(t) for t in tmp.snapshot_grid(2, fx.MAX_STEPS)])
    steps = F.array(*[
        F.min(F.when(F.col("feature_id") == int(i), F.col("first_step"))) for i in s.ids]).alias("_steps")
    fired = samples.select("sample_id", "label").join(first.groupBy("sample_id").agg(steps), "sample_id", "left")
    never = F.array(*[F.lit(None).cast("int")] * len(s.ids))
    seen = F.transform(F.coalesce("_steps", never), lambda x: F.coalesce(x < F.col("t"), F.lit(False)).cast("double"))
    rows = fired.withColumn("t", F.explode(grid)).withColumn("features", array_to_vector(seen))
    return stage(pat.patterns(rows, s.classes, ["t"]))


def _snapshot_fits(s):
    """One logistic model per snapshot, on the vectors seen by then, each a task."""
    train, test = (_snapshot_patterns(s, s.picks(first), samples) for first, samples in (
        (s.train_first, s.train), (s.test_first, s.test)))
    return stage(pat.run_fits(train, test, _logistic_fits([SNAPSHOT_C]), ["t"]))


@query("d14_snapshot_logistic")
def d14_logistic(spark, sf_dir):
    s = Vectors(spark, sf_dir)
    return pat.accuracies(_snapshot_fits(s), ["t"]).select(
        F.concat(F.lit("t="), F.col("t").cast("string")).alias("dataset"), "config",
        F.create_map().cast("map<string,string>").alias("params"), "accuracy", "n_test")


cte("snapshot_patterns", ("picks", "train"), """
  SELECT g.t::INTEGER AS t, t.sample_id,
    coalesce(string_agg(p.feature_id::VARCHAR, ',' ORDER BY p.feature_id), '') AS x
  FROM train t CROSS JOIN (VALUES """ + ", ".join(f"({t})" for t in tmp.snapshot_grid(2, fx.MAX_STEPS)) + """) g(t)
  LEFT JOIN picks p ON p.sample_id = t.sample_id AND p.first_step < g.t GROUP BY g.t, t.sample_id""")


@query("d14_snapshot_optimum", with_ctes("snapshot_patterns", """
  SELECT t, count(*) AS n_rows, count(DISTINCT x) AS n_patterns, true AS at_optimum FROM snapshot_patterns GROUP BY t"""))
def d14_optimum(spark, sf_dir):
    """What each snapshot's model was fitted on, and that its gradient vanishes."""
    rows = pat.facts(_snapshot_fits(Vectors(spark, sf_dir)), ["t"])
    return rows.select(
        "t", F.col("facts")["n_rows"].cast("long").alias("n_rows"),
        F.col("facts")["n_patterns"].cast("long").alias("n_patterns"),
        (F.col("facts")["gradient"] < sol.GRADIENT).alias("at_optimum"))
