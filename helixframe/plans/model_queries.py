"""Queries over generators and models (GEN, MDL), and round trips through sources and sinks (SRC, SNK).

Models that are fitted iteratively have no SQL form: their queries return predictions or
held-out errors, and tests compare them with direct solutions.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from helixframe.functions.bases import group_right_open
from helixframe.models import forests, linear, networks, trees
from helixframe.models.features import encode, one_hot
from helixframe.operators import generate, metrics, profile
from helixframe.session import checkpoint
from helixframe.plans.catalog import query
from helixframe.sources import readers, sinks
from helixframe.sources.fixtures import view


def _scratch(spark, tag: str) -> str:
    """A new path in the folder that driver and executors share."""
    checkpoint(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/plans/{tag}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- round trips


@query("src04_required_csv", "SELECT cast(lib_id AS STR) AS lib_id, m2, quality FROM library")
def src04(spark, d):
    path = _scratch(spark, "csv")
    rows = view(spark, d, "library").select(F.col("lib_id").cast("string").alias("﻿lib_id"), "m2", "m3", "quality")
    rows.write.csv(path, header=True)
    return readers.read_required_csv(spark, path, ["lib_id", "m2", "quality"])


@query("src05_padded_tsv", "SELECT cast(sample_index AS STR) AS sample_index, sequence FROM sequences")
def src05(spark, d):
    path = _scratch(spark, "tsv")
    rows = view(spark, d, "sequences").select(F.concat(F.lit("  "), F.col("sample_index").cast("string")).alias("sample_index "), F.concat("sequence", F.lit("  ")).alias(" sequence"))
    rows.write.csv(path, header=True, sep="\t", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_padded_tsv(spark, path)


@query("src07_fasta", "SELECT concat('piece_', cast(piece AS STR), ' derived') AS name, bases AS sequence FROM genome_pieces")
def src07(spark, d):
    path = _scratch(spark, "fasta")
    rows = view(spark, d, "genome_pieces").select(F.concat(F.lit("piece_"), F.col("piece").cast("string")).alias("name"), F.lit("derived").alias("status"), F.col("bases").alias("sequence"))
    sinks.write_fasta(rows, path, ["name", "status"])
    return readers.read_fasta(spark, path, "piece_")


@query("src09_text_list", "SELECT sequence FROM sequences")
def src09(spark, d):
    path = _scratch(spark, "list")
    view(spark, d, "sequences").select(F.explode(F.array(F.lower("sequence"), F.lit(" "))).alias("value")).write.text(path)
    return readers.read_text_list(spark, path, 50)


@query("src11_json_report", "SELECT round(avg(y), 6) AS mean, count(*) AS n FROM labelled")
def src11(spark, d):
    path = _scratch(spark, "report")
    row = view(spark, d, "labelled").agg(F.round(F.avg("y"), 6).alias("mean"), F.count("*").alias("n")).first()
    spark.createDataFrame([(sinks.report_text(row.asDict()),)], "value string").coalesce(1).write.text(path)
    return readers.read_report(spark, path).select(F.col("mean").cast("double").alias("mean"), F.col("n").cast("long").alias("n"))


@query("src13_species_scan", "SELECT CASE WHEN sample_index % 2 = 0 THEN 'alpha' ELSE 'beta' END AS species, count(*) AS n_rows, count(DISTINCT sequence) AS n_unique FROM sequences GROUP BY 1")
def src13(spark, d):
    path = _scratch(spark, "species")
    for name, k in (("alpha", 0), ("beta", 1)):
        view(spark, d, "sequences").where(F.col("sample_index") % 2 == k).select("sample_index", "sequence").write.csv(f"{path}/{name}", header=True)
    return readers.read_species(spark, path).groupBy("species").agg(F.count("*").alias("n_rows"), F.count_distinct("sequence").alias("n_unique"))


@query("snk01_csv", "SELECT sample_index, sequence, CASE WHEN sample_index % 2 = 0 THEN 'True' ELSE 'False' END AS even, CASE WHEN sample_index % 3 = 0 THEN NULL ELSE split END AS split FROM labelled")
def snk01(spark, d):
    path = _scratch(spark, "out")
    rows = view(spark, d, "labelled").select("split", "sequence", "sample_index", (F.col("sample_index") % 2 == 0).alias("even")).withColumn("split", F.when(F.col("sample_index") % 3 != 0, F.col("split")))
    sinks.write_csv(rows, path, ["sample_index", "sequence", "even", "split"])
    return spark.read.schema("sample_index long, sequence string, even string, split string").csv(path, header=True)


@query("snk03_fasta", "SELECT concat('>', cast(sample_index AS STR), ' ', split) AS head, sequence FROM labelled")
def snk03(spark, d):
    path = _scratch(spark, "fasta")
    sinks.write_fasta(view(spark, d, "labelled"), path, ["sample_index", "split"])
    return readers.read_fasta(spark, path).select(F.concat(F.lit(">"), "name").alias("head"), "sequence")


# --------------------------------------------------------------------------- generators

_GRP = "CASE WHEN y < 2.97 THEN 'weak' WHEN y < 2.985 THEN 'medium' ELSE 'strong' END"
_POS = "(SELECT unnest(range(0, 50)) AS pos) p"
_TOK = "(SELECT unnest(['A', 'C', 'G', 'T']) AS token) t"


def _train(spark, d):
    return view(spark, d, "labelled").where("split = 'train'").withColumn("cond", group_right_open(F.col("y"), 2.97, 2.985))


@query("gen01_position_table", f"SELECT pos, token, round((sum(CASE WHEN substr(sequence, cast(pos + 1 AS int), 1) = token THEN 1 ELSE 0 END) + 1.0) / (count(*) + 4.0), 6) AS p FROM labelled, {_POS}, {_TOK} WHERE split = 'train' GROUP BY 1, 2")
def gen01(spark, d):
    return generate.position_table(_train(spark, d), 50).select("pos", "token", F.round("p", 6).alias("p"))


@query("gen01_position_sample")
def gen01_sample(spark, d):
    requests = spark.range(500).select(F.col("id").alias("sample_index"))
    return generate.sample_positions(requests, generate.position_table(_train(spark, d), 50), 50, 25)


@query("gen02_conditional_table", f"SELECT cond, pos, token, round((sum(CASE WHEN substr(sequence, cast(pos + 1 AS int), 1) = token THEN 1 ELSE 0 END) + 1.0) / (count(*) + 4.0), 6) AS p FROM (SELECT *, {_GRP} AS cond FROM labelled WHERE split = 'train') l, {_POS}, {_TOK} GROUP BY 1, 2, 3")
def gen02(spark, d):
    return generate.position_table(_train(spark, d), 50, 1.0, ["cond"]).select("cond", "pos", "token", F.round("p", 6).alias("p"))


@query("gen02_conditional_sample")
def gen02_sample(spark, d):
    requests = spark.range(600).select(F.col("id").alias("sample_index"), F.element_at(F.array(F.lit("weak"), F.lit("medium"), F.lit("strong")), (F.col("id") % 3 + 1).cast("int")).alias("cond"))
    return generate.sample_positions(requests, generate.position_table(_train(spark, d), 50, 1.0, ["cond"]), 50, 25, ["cond"])


def _markov_sql(cond: str, prior: str) -> str:
    return f"""WITH steps AS (SELECT {cond} AS cond, pos, substr(concat('^^', sequence), cast(pos + 1 AS int), 2) AS context, substr(sequence, cast(pos + 1 AS int), 1) AS token FROM labelled, {_POS} WHERE split = 'train'),
      c AS (SELECT cond, pos, context, token, count(*) AS n FROM steps GROUP BY ALL), tot AS (SELECT cond, pos, context, sum(n) AS total FROM c GROUP BY ALL),
      f AS (SELECT cond, pos, token, count(*) AS n FROM steps GROUP BY ALL), ft AS (SELECT cond, pos, sum(n) AS total FROM f GROUP BY ALL)
      SELECT cond, pos, context, token, round((coalesce(c.n, 0) + {prior}) / (tot.total + 0.4), 6) AS p FROM tot CROSS JOIN {_TOK} LEFT JOIN c USING (cond, pos, context, token) LEFT JOIN f USING (cond, pos, token) LEFT JOIN ft USING (cond, pos)"""


@query("gen03_markov_table", _markov_sql(_GRP, "0.1"))
def gen03(spark, d):
    return generate.markov_table(_train(spark, d), 2, 50, 0.1).select("cond", "pos", "context", "token", F.round("p", 6).alias("p"))


def _requests(spark, fit, n: int):
    """Requests that go round the conditions of the training rows: a label that was not fitted would raise."""
    known = sorted(r["cond"] for r in fit.select("cond").distinct().collect())
    return spark.range(n).select(F.col("id").alias("sample_index"), F.element_at(F.array(*map(F.lit, known)), (F.col("id") % len(known) + 1).cast("int")).alias("low"))


@query("gen03_markov_sample")
def gen03_sample(spark, d):
    fit = _train(spark, d)
    sampler = generate.MarkovSampler(generate.markov_table(fit, 2, 50, 0.1), generate.position_table(fit, 50, 1.0, ["cond"]), 2, 50)
    return sampler.sample(_requests(spark, fit, 600).withColumn("high", F.col("low")).withColumn("weight", F.lit(0.0)), 25)


_BIN = "(SELECT l.*, cast(y > e1 AS int) + cast(y > e2 AS int) + cast(y > e3 AS int) AS cond FROM labelled l, (SELECT quantile_cont(y, 0.25) AS e1, quantile_cont(y, 0.5) AS e2, quantile_cont(y, 0.75) AS e3 FROM labelled WHERE split = 'train') e WHERE split = 'train')"


@query("gen04_bins_and_centres", f"SELECT cond, round(avg(y), 6) AS centre, count(*) AS n FROM {_BIN} b GROUP BY 1")
def gen04_bins(spark, d):
    binned, _ = generate.condition_bins(_train(spark, d).drop("cond"), "y", 4)
    return generate.bin_centres(binned, "y").select("cond", F.round("centre", 6).alias("centre"), "n")


@query("gen04_continuous_table", _markov_sql("cond", "0.1").replace("FROM labelled,", f"FROM {_BIN} b,"))
def gen04(spark, d):
    binned, _ = generate.condition_bins(_train(spark, d).drop("cond"), "y", 4)
    return generate.markov_table(binned, 2, 50, 0.1).select("cond", "pos", "context", "token", F.round("p", 6).alias("p"))


@query("gen04_continuous_sample")
def gen04_sample(spark, d):
    binned, _ = generate.condition_bins(_train(spark, d).drop("cond"), "y", 4)
    sampler = generate.MarkovSampler(generate.markov_table(binned, 2, 50, 0.1), generate.position_table(binned, 50, 0.1, ["cond"]), 2, 50)
    asked = spark.range(500).select(F.col("id").alias("sample_index"), (2.95 + F.col("id") / 500.0 * 0.06).alias("target"))
    return sampler.sample(generate.centre_weights(asked, generate.bin_centres(binned, "y"), "target"), 25)


@query("gen05_position_prior_table", _markov_sql(_GRP, "0.4 * (coalesce(f.n, 0) + 0.1) / (ft.total + 0.4)"))
def gen05(spark, d):
    fit = _train(spark, d)
    prior = generate.position_table(fit, 50, 0.1, ["cond"])
    return generate.markov_table(fit, 2, 50, 0.1, prior=prior).select("cond", "pos", "context", "token", F.round("p", 6).alias("p"))


#: Most training rows that networks and trees are fitted on: they train on one machine.
MOST_TRAINING = 20_000


def _training(spark, d, most: int = MOST_TRAINING):
    """Training strings and labels for models that fit on one machine: a hash sample of at most ``most`` rows of the training split."""
    return linear.hashed_sample(view(spark, d, "labelled").where("split = 'train'"), most)


@query("gen06_conditional_vae")
def gen06(spark, d):
    texts, y = _training(spark, d)
    model = networks.ConditionalVae().fit(texts, y, epochs=6, seed=25)
    shared = spark.sparkContext.broadcast(model)
    from helixframe.shipping import arrow_map

    def run(batches):
        import pyarrow as pa

        for b in batches:
            drawn = shared.value.draw(b.column("sample_index").to_pylist(), b.column("target").to_pylist(), 25)
            yield pa.RecordBatch.from_arrays([b.column("sample_index"), b.column("target"), pa.array(drawn, pa.string())], names=["sample_index", "target", "sequence"])

    asked = spark.range(300).select(F.col("id").alias("sample_index"), (2.95 + F.col("id") / 300.0 * 0.06).alias("target"))
    return arrow_map(asked, run, "sample_index long, target double, sequence string")


@query("gen07_generator_contract", "SELECT cast(500 AS bigint) AS n, cast(500 AS bigint) AS valid, 50 AS length")
def gen07(spark, d):
    rows = gen01_sample(spark, d)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("sequence").rlike("^[ACGT]{50}$")).alias("valid"), F.max(F.length("sequence")).alias("length"))


# --------------------------------------------------------------------------- models


def _errors(spark, d, predict, name: str):
    """Held-out errors of a predictor by split."""
    scored = linear.score_rows(view(spark, d, "labelled"), predict).join(view(spark, d, "labelled").select("sample_index", "y", "split"), "sample_index")
    return metrics.regression_metrics(scored, "y", "score", ["split"]).withColumn("model", F.lit(name))


@query("mdl01_ridge")
def mdl01(spark, d):
    return _errors(spark, d, linear.Ridge.fit(_train(spark, d)).predict, "ridge")


@query("mdl02_position_ridge")
def mdl02(spark, d):
    return _errors(spark, d, linear.PositionRidge.fit(_train(spark, d), alpha=10.0).predict, "position_ridge")


@query("mdl03_fourier_ridge")
def mdl03(spark, d):
    texts, _ = _training(spark, d)  # for the scale of the features; the ridge reads every training row
    features = linear.FourierFeatures.fit(texts, seed=3)
    return _errors(spark, d, linear.Ridge.fit(_train(spark, d), features).predict, "fourier_ridge")


@query("mdl04_svr_inference")
def mdl04(spark, d):
    texts, y = _training(spark, d, linear.MOST_KERNEL)
    return _errors(spark, d, linear.fit_svr(texts, y, epsilon=0.005, steps=100).predict, "svr")


def _network(name: str, make, losses: tuple[str, ...] = ("mse",)):
    @query(name)
    def run(spark, d):
        texts, y = _training(spark, d)
        cut = len(texts) * 4 // 5
        out = None
        for loss in losses:
            model = make().fit(texts[:cut], y[:cut], (texts[cut:], y[cut:]), epochs=4, seed=1, loss_name=loss)
            part = _errors(spark, d, model.predict, name.split("_", 1)[1]).withColumn("loss", F.lit(loss))
            out = part if out is None else out.unionByName(part)
        return out

    return run


_network("mdl05_motif_cnn", networks.MotifCnn)
_network("mdl06_multiscale_cnn", networks.multiscale_cnn)
_network("mdl07_position_mlp", networks.PositionMlp)
_network("mdl08_recurrent", networks.Recurrent, ("mse", "huber", "rank", "tail", "balanced"))
_network("mdl09_gated", networks.Gated)


@query("mdl10_svr_training")
def mdl10(spark, d):
    """The support vectors of a fit, and its errors over all rows by split."""
    texts, y = _training(spark, d, linear.MOST_KERNEL)
    model = linear.fit_svr(texts, y, epsilon=0.005, steps=100)
    fitted = _errors(spark, d, model.predict, "svr")
    return fitted.withColumn("vectors", F.lit(len(model.coefficients))).withColumn("bounded", F.lit(bool(np.abs(model.coefficients).max() <= 1.0 + 1e-9)))


@query("mdl11_kernel_ridge")
def mdl11(spark, d):
    texts, y = _training(spark, d, linear.MOST_KERNEL)
    return _errors(spark, d, linear.KernelRidge.fit(texts, y).predict, "kernel_ridge")


@query("mdl12_extra_trees")
def mdl12(spark, d):
    texts, y = _training(spark, d)
    return _errors(spark, d, trees.extra_trees(spark, texts, y).predict, "extra_trees")


@query("mdl13_histogram_boosting")
def mdl13(spark, d):
    texts, y = _training(spark, d)
    return _errors(spark, d, trees.histogram_boosting(texts, y).predict, "histogram_boosting")


@query("mdl14_logistic")
def mdl14(spark, d):
    rows = forests.with_features(view(spark, d, "labelled")).withColumn("label", (F.col("y") >= 2.985).cast("int"))
    fit = rows.where("split = 'train'")
    scored = forests.logistic_scores(rows, fit).join(rows.select("sample_index", "label", "split"), "sample_index").where("split = 'test'")
    return metrics.confusion(scored, "score", "label").withColumn("majority", F.lit(forests.majority(fit)))


@query("mdl15_ensemble_mean", "SELECT sample_index, round((y + score_a + score_b) / 3, 9) AS score FROM scores")
def mdl15(spark, d):
    return view(spark, d, "scores").select("sample_index", F.round((F.col("y") + F.col("score_a") + F.col("score_b")) / 3, 9).alias("score"))


@query(
    "mdl16_weight_grid",
    """SELECT w0, w1, w2, round(avg(abs(w0 * score_a + w1 * score_b + w2 * 2.98D - y)), 6) AS mae FROM scores,
       (SELECT i / 10.0D AS w0, j / 10.0D AS w1, (10 - i - j) / 10.0D AS w2 FROM (SELECT unnest(range(0, 11)) AS i) a, (SELECT unnest(range(0, 11)) AS j) b WHERE i + j <= 10) g GROUP BY 1, 2, 3""",
)
def mdl16(spark, d):
    return linear.grid_search(view(spark, d, "scores").withColumn("flat", F.lit(2.98)), ("score_a", "score_b", "flat"), "y")


def _folded(spark, d):
    return view(spark, d, "scores").join(view(spark, d, "sequences").select("sample_index", "sequence"), "sample_index")


@query("mdl17_out_of_fold")
def mdl17(spark, d):
    out = linear.out_of_fold(_folded(spark, d), lambda texts, y: linear.KernelRidge.fit(texts, y).predict)
    return out.select("sample_index", "fold", F.round("observed", 6).alias("observed"), F.round("predicted", 6).alias("predicted"))


def _nested(texts: list[str], y: np.ndarray):
    """Kernel ridge with an affine calibration learnt on two inner folds."""
    half = np.arange(len(texts)) % 2
    strings, raw = np.array(texts, dtype=object), np.empty(len(texts))
    for k in (0, 1):
        raw[half == k] = linear.KernelRidge.fit(strings[half != k].tolist(), y[half != k]).predict(strings[half == k].tolist())
    spread = raw.var()
    slope = float(((raw - raw.mean()) * (y - y.mean())).mean() / spread) if spread > 0 else 0.0
    return linear.Calibrated(linear.KernelRidge.fit(texts, y), slope, float(y.mean() - slope * raw.mean())).predict


@query("mdl18_nested_calibration")
def mdl18(spark, d):
    out = linear.out_of_fold(_folded(spark, d), _nested)
    return metrics.regression_metrics(out, "observed", "predicted", ["fold"])


@query("mdl19_filter_mining")
def mdl19(spark, d):
    """Filters are learnt on a sample; the windows that excite them most are sought in all training rows."""
    texts, y = _training(spark, d)
    model = networks.MotifCnn(options={"filters": [(7, 8)], "bins": 5}).fit(texts, y, epochs=2, seed=1)
    windows = networks.excited_windows(view(spark, d, "labelled").where("split = 'train'"), model, 7, 8, 50)
    return profile.consensus(windows, ["filter"])


@query("src12_checkpoint_round_trip", "SELECT count(*) AS n, cast(0 AS bigint) AS differs FROM sequences")
def src12(spark, d):
    import os
    import tempfile

    texts, y = _training(spark, d)
    model = networks.MotifCnn().fit(texts, y, epochs=1)
    with tempfile.TemporaryDirectory() as folder:  # a checkpoint is written and read by the driver alone
        path = os.path.join(folder, "model.npz")
        model.save(path)
        again = networks.MotifCnn.load(path)
    rows = view(spark, d, "sequences")
    a = linear.score_rows(rows, model.predict)
    b = linear.score_rows(rows, again.predict, name="again")
    return a.join(b, "sample_index").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("score") - F.col("again")) > 1e-12).alias("differs"))


@query("prj12_one_hot_matrix", "SELECT sample_index, pos - 1 AS pos, strpos('ACGT', substr(sequence, cast(pos AS int), 1)) - 1 AS hot FROM sequences, (SELECT unnest(range(1, 51)) AS pos) p")
def prj12_matrix(spark, d):
    """Every row as a one-hot matrix; returned are the places of its ones."""
    import pyarrow as pa

    from helixframe.shipping import arrow_map

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row, pos, hot = np.nonzero(one_hot(encode(batch.column("sequence").to_pylist())))
                yield pa.RecordBatch.from_arrays([batch.column("sample_index").take(pa.array(row)), pa.array(pos), pa.array(hot)], names=["sample_index", "pos", "hot"])

    return arrow_map(view(spark, d, "sequences").select("sample_index", "sequence"), run, "sample_index long, pos long, hot long")


# --------------------------------------------------------------------------- documents, charts and archives


def _put(spark, path: str, data: bytes) -> None:
    """Write a small file from the driver into the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(data))
    stream.close()


@query("src08_workbook", "SELECT cast(n_nationkey AS STR) AS ID, n_name AS name FROM nation")
def src08(spark, d):
    import io
    import zipfile

    from helixframe.sources.fixtures import table

    rows = [("ID", "name"), *((str(r["n_nationkey"]), r["n_name"]) for r in table(spark, d, "nation").collect())]
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    body = "".join(f"<row>{cell(f'A{i}', a)}{cell(f'B{i}', b)}</row>" for i, (a, b) in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    path = f"{_scratch(spark, 'book')}/nations.xlsx"
    _put(spark, path, out.getvalue())
    return readers.read_workbook(spark, path, "ID")


@query("src10_configuration", "SELECT 'split' AS section, 'train_ratio' AS key, '0.7' AS value UNION ALL SELECT 'split', 'rest_ratio', '0.3' UNION ALL SELECT 'data', 'label_transform', 'log10'")
def src10(spark, d):
    text = '[project]\n[data]\nlabel_transform = "log10"\n[split]\ntrain_ratio = 0.7\nrest_ratio = 0.3\n[features]\n[model]\n'
    config = readers.load_config(text)
    return spark.createDataFrame([(s, k, str(v)) for s, part in config.sections.items() for k, v in part.items()], "section string, key string, value string")


@query("snk02_json_report", "SELECT split, round(avg(y), 6) AS mean FROM labelled GROUP BY 1")
def snk02(spark, d):
    rows = view(spark, d, "labelled").groupBy("split").agg(F.round(F.avg("y"), 6).alias("mean")).collect()
    path = f"{_scratch(spark, 'json')}/report.json"
    _put(spark, path, sinks.report_text({"splits": [r.asDict() for r in rows]}).encode())
    return readers.read_report(spark, path).select(F.explode("splits").alias("s")).select("s.split", "s.mean")


@query("snk05_markdown_report", "SELECT concat('| ', split, ' | ', cast(count(*) AS STR), ' |') AS line FROM labelled GROUP BY split")
def snk05(spark, d):
    rows = [tuple(r) for r in view(spark, d, "labelled").groupBy("split").agg(F.count("*").alias("n")).collect()]
    text = sinks.markdown_report("Splits", [("Rows", ["split", "n"], rows)])
    lines = [(x,) for x in text.splitlines() if x.startswith("| ") and "---" not in x and "split" not in x]
    return spark.createDataFrame(lines, "line string")


@query("snk06_charts", "SELECT 'bars' AS chart, 30 AS marks UNION ALL SELECT 'line', 30 UNION ALL SELECT 'heat', 200")
def snk06(spark, d):
    rows = view(spark, d, "sequences")
    bins = [r["n"] for r in profile.histogram(rows, "strength").orderBy("bin").collect()]
    freq: dict[int, list[float]] = {}
    for r in profile.position_frequency(rows, 1, 50).orderBy("pos", "token").collect():
        freq.setdefault(r["pos"], []).append(r["freq"])
    bars, line, heat = sinks.bar_chart([str(i) for i in range(30)], bins), sinks.line_chart(bins), sinks.heat_map(list(freq.values()))
    return spark.createDataFrame([("bars", bars.count("<rect")), ("line", line.count(",")), ("heat", heat.count("<rect"))], "chart string, marks int")


@query("snk08_run_logger", "SELECT 'pipeline.log' AS name, 2 AS lines, 2 AS handlers, true AS replaced")
def snk08(spark, d):
    """A logger asked for twice has one console and one file handler, and writes each message once; the driver's log is the driver's alone."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:
        first = sinks.run_logger("helixframe.check", f"{folder}/run-1", level="ERROR")
        log = sinks.run_logger("helixframe.check", f"{folder}/run-2", level="WARNING")
        log.info("below the level")
        for message in ("one", "zwei \u00fc"):
            log.warning(message)
        handlers = len(log.handlers)
        sinks.close_logger(log)
        lines = [x for p in Path(folder).glob("run-*/*.log") for x in p.read_text(encoding="utf-8").splitlines()]
    return spark.createDataFrame([("pipeline.log", len(lines), handlers, first is log)], "name string, lines int, handlers int, replaced boolean")


@query("snk07_archive_manifest", "SELECT concat('item_', cast(item_id AS STR), '.txt') AS name, sha256(text) AS sha256 FROM benchmark")
def snk07(spark, d):
    from helixframe.sources.fixtures import table

    files = {f"item_{r['item_id']}.txt": r["text"].encode() for r in table(spark, d, "benchmark").collect()}
    listed = sinks.manifest(files)
    sinks.verify_zip(sinks.deterministic_zip(files), listed)
    return spark.createDataFrame(list(listed.items()), "name string, sha256 string")
