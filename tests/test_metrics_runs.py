"""Metrics (D8, D11, D12) against plain-Python implementations of the
published algorithms; run-log operators (P9, P13, P14, X7, B11, B13)."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bitext.operators import metrics as M
from bitext.operators import runs as R
from bitext.plans import fixtures as fx
from bitext.sources import logs as L

from .conftest import SF_SMALL

# --- plain-Python BLEU / chrF (brute force) --------------------------------
_RULES = [
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def tok13a(line):
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in line:
        line = line.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    line = f" {line} "
    for rx, rep in _RULES:
        line = rx.sub(rep, line)
    return line.split()


def py_bleu(hyps, refs):
    m, t = [0] * 4, [0] * 4
    sys_len = ref_len = 0
    for h, r in zip(hyps, refs):
        ht, rt = tok13a(h), tok13a(r)
        sys_len += len(ht)
        ref_len += len(rt)
        for n in range(1, 5):
            hc = Counter(tuple(ht[i: i + n]) for i in range(len(ht) - n + 1))
            rc = Counter(tuple(rt[i: i + n]) for i in range(len(rt) - n + 1))
            m[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            t[n - 1] += max(0, len(ht) - n + 1)
    if not any(m) or min(t) == 0 or sys_len == 0:
        return 0.0
    p, smooth = [], 1.0
    for n in range(4):
        if m[n] == 0:
            smooth *= 2
            p.append(100.0 / (smooth * t[n]))
        else:
            p.append(100.0 * m[n] / t[n])
    bp = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return bp * math.exp(sum(math.log(x) for x in p) / 4)


def py_chrf(hyps, refs, order=6, beta=2.0):
    tot = [[0, 0, 0] for _ in range(order)]
    for h, r in zip(hyps, refs):
        h, r = "".join(h.split()), "".join(r.split())
        for n in range(1, order + 1):
            hc = Counter(h[i: i + n] for i in range(len(h) - n + 1))
            rc = Counter(r[i: i + n] for i in range(len(r) - n + 1))
            hn, rn = sum(hc.values()), sum(rc.values())
            tot[n - 1][0] += hn if rn > 0 else 0
            tot[n - 1][1] += rn
            tot[n - 1][2] += sum(min(c, rc[g]) for g, c in hc.items())
    ap = ar = 0.0
    k = 0
    for hn, rn, mn in tot:
        if hn > 0 and rn > 0:
            ap += mn / hn
            ar += mn / rn
            k += 1
    if k == 0:
        return 0.0
    ap, ar = ap / k, ar / k
    if ap + ar == 0:
        return 0.0
    f = beta * beta
    return 100 * (1 + f) * ap * ar / (f * ap + ar)


def test_bleu_chrf_match_brute_force_on_fixture(spark):
    h, r = fx.hyps(spark, SF_SMALL), fx.refs(spark, SF_SMALL)
    pairs = sorted((x.sent_id, x.hyp, x.ref) for x in h.join(r, "sent_id").collect())
    hyps, refs = [p[1] for p in pairs], [p[2] for p in pairs]
    assert M.corpus_bleu(h, r).first().bleu == pytest.approx(py_bleu(hyps, refs), rel=1e-9)
    assert M.corpus_chrf(h, r).first().chrf == pytest.approx(py_chrf(hyps, refs), rel=1e-9)


@pytest.mark.parametrize(
    "hyps,refs",
    [
        (["the cat sat on the mat ."], ["the cat is on the mat ."]),
        (["a b"], ["c d e f g"]),  # no match -> 0
        (["x"], ["x"]),  # orders without totals -> 0
        (["3.5 - 4 , and &amp; co"], ["3.5-4, and & co"]),
        (["the the the the"], ["the cat"]),  # clipping
    ],
)
def test_bleu_chrf_edge_cases(spark, hyps, refs):
    h = spark.createDataFrame(list(enumerate(hyps)), "sent_id long, hyp string")
    r = spark.createDataFrame(list(enumerate(refs)), "sent_id long, ref string")
    assert M.corpus_bleu(h, r).first().bleu == pytest.approx(py_bleu(hyps, refs), abs=1e-9)
    assert M.corpus_chrf(h, r).first().chrf == pytest.approx(py_chrf(hyps, refs), abs=1e-9)


def test_missing_predictions_are_inner_joined(spark):
    h = spark.createDataFrame([(1, "a b c d")], "sent_id long, hyp string")
    r = spark.createDataFrame([(1, "a b c d"), (2, "zzz")], "sent_id long, ref string")
    assert M.corpus_bleu(h, r).first().bleu == pytest.approx(100.0)


def test_perplexity_cap(spark):
    df = spark.createDataFrame([(0, 99.9), (0, 99.9), (1, 100.0)], "batch_id long, loss double")
    row = M.perplexity(df.where("batch_id = 0")).first()
    assert row.ppl == pytest.approx(math.exp(99.9))
    assert M.perplexity(df.where("batch_id = 1")).first().ppl == math.inf


# --- runs -------------------------------------------------------------------


@pytest.mark.parametrize(
    "name,want",
    [
        ("tf_sanity_click_20240101_000000", "sanity_click"),
        ("tf_a_b_c_20240101_000000", "a_b_c"),
        ("tf_x_2024", "tf_x_2024"),  # 3 parts -> whole name
        ("plain", "plain"),
    ],
)
def test_run_name_rule(spark, name, want):
    df = spark.createDataFrame([(name,)], "d string")
    assert df.select(L.run_name_from_dir(F.col("d")).alias("r")).first().r == want


def test_runs_scan_latest_wins_and_report_rows(spark, tmp_path):
    rows = []
    for d, n in [("tf_s_a_20240101_000000", 12), ("tf_s_a_20240102_000000", 9), ("tf_s_b_20240101_000000", 3)]:
        for e in range(1, n + 1):
            rows.append((d, e, 1.0 / e, 2.0 / e if d.endswith("2_000000") else 1.5 / e, 1e-4, 1.0))
    df = spark.createDataFrame(rows, "run_dir string, epoch int, train_loss double, val_loss double, learning_rate double, epoch_time_sec double")
    base = str(tmp_path / "logs")
    L.write_metrics_csv(df, base)
    runs = L.scan_runs(spark, base)
    dirs = {r.run: r.run_dir for r in runs.select("run", "run_dir").distinct().collect()}
    assert dirs == {"s_a": "tf_s_a_20240102_000000", "s_b": "tf_s_b_20240101_000000"}
    rep = {r.run: r.epoch for r in R.experiment_report(runs).collect()}
    assert rep == {"s_a": 9, "s_b": 3}  # fewer than 10 epochs -> last row


def test_train_loss_rollup_accumulation_not_dividing(spark):
    rows = [("r", 1, b, 0.1 * (b + 1)) for b in range(7)]
    df = spark.createDataFrame(rows, "run string, epoch int, batch long, loss double")
    got = R.train_loss_rollup(df, 3).first()
    # Update steps at batches 2 and 5; divided by 7/3 as a real.
    assert got.n_updates == 2
    assert got.train_loss == pytest.approx((0.3 + 0.6) / (7 / 3))


def test_best_checkpoint_is_strict(spark):
    df = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 1.0), ("r", 3, 1.0), ("r", 4, 1.5)], "run string, epoch int, val_loss double")
    got = {r.epoch: (r.improved, r.best_before) for r in R.best_checkpoint(df).collect()}
    assert got == {1: (True, math.inf), 2: (True, 2.0), 3: (False, 1.0), 4: (False, 1.0)}
    reg = R.checkpoint_registry(df).first()
    assert (reg.best_epoch, reg.latest_epoch, reg.resolved_kind) == (2, 4, "best")


def test_request_filter_quit_ends_session(spark):
    df = spark.createDataFrame(
        [(1, 0, "hi"), (1, 1, " "), (1, 2, "EXIT"), (1, 3, "later"), (2, 0, " q "), (2, 1, "Q")],
        "session_id long, request_id long, text string",
    )
    got = sorted((r.session_id, r.request_id, r.text) for r in R.filter_requests(df).collect())
    # " q " is not a quit word (no strip before the check), "Q" is.
    assert got == [(1, 0, "hi"), (2, 0, "q")]


def test_read_corpus_takes_train_split_and_renames(spark, tmp_path):
    from bitext.sources.corpus import read_corpus

    rows = [("train", "你好", "Hello"), ("validation", "再见", "Bye"), ("train", None, "x")]
    spark.createDataFrame(rows, "split string, text_zh string, text_en string").coalesce(1).write.parquet(
        str(tmp_path / "ds")
    )
    got = sorted((r.pair_id, r.src, r.tgt) for r in read_corpus(spark, str(tmp_path / "ds")).collect())
    assert got == [(0, "你好", "Hello"), (1, None, "x")]


def test_scalar_log_sink_appends(spark, tmp_path):
    steps = spark.createDataFrame(
        [("r", 1, 0, 1, 0.5, 1e-4), ("r", 1, 1, 2, 0.4, 1e-4)],
        "run string, epoch int, batch long, step long, loss double, learning_rate double",
    )
    epochs = spark.createDataFrame([("r", 1, 0.45, 0.5)], "run string, epoch int, train_loss double, val_loss double")
    s = R.scalar_log(steps, epochs)
    path = str(tmp_path / "scalars")
    L.write_scalars(s, path)
    L.write_scalars(s, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 * s.count() == 12
    assert {r.tag for r in back.select("tag").distinct().collect()} == {
        "Train/Loss_Step", "Train/Learning_Rate", "Train/Loss_Epoch", "Val/Loss_Epoch"
    }


def test_examples_first_three(spark):
    h = spark.createDataFrame([(i, f"h{i}") for i in range(5, 0, -1)], "sent_id long, hyp string")
    r = spark.createDataFrame([(i, f"r{i}") for i in range(6)], "sent_id long, ref string")
    assert [x.sent_id for x in R.examples(h, r).collect()] == [1, 2, 3]


def test_report_row_choice_and_ppl_cap(spark):
    rows = []
    for run, n in (("r9", 9), ("r10", 10), ("r11", 11)):
        for e in range(1, n + 1):
            val = 99.9 if (run, e) == ("r10", 10) else (100.0 if (run, e) == ("r11", 10) else 1.0)
            rows.append((run, e, 0.5, val))
    df = spark.createDataFrame(rows, "run string, epoch int, train_loss double, val_loss double")
    rep = {r.run: (r.epoch, r.ppl) for r in R.experiment_report(df).collect()}
    assert rep["r9"] == (9, pytest.approx(math.e))  # fewer than 10 -> last
    assert rep["r10"][0] == 10 and rep["r10"][1] == pytest.approx(math.exp(99.9))
    assert rep["r11"] == (10, math.inf)  # 10th row of 11; val_loss 100 -> inf


def test_scalar_log_update_steps_with_accumulation(spark):
    steps = spark.createDataFrame(
        [("r", 1, b, b + 1, 0.1 * b, 1e-4) for b in range(7)],
        "run string, epoch int, batch long, step long, loss double, learning_rate double",
    )
    epochs = spark.createDataFrame([("r", 1, 0.3, 0.4)], "run string, epoch int, train_loss double, val_loss double")
    got = sorted(
        (r.step, round(r.value, 9))
        for r in R.scalar_log(steps, epochs, accumulation_steps=3).where("tag = 'Train/Loss_Step'").collect()
    )
    assert got == [(1, 0.2), (2, 0.5)]  # batches 2 and 5 are update steps 1 and 2


def test_config_overlay_nulls_keep_base(spark):
    over = spark.createDataFrame(
        [("baseline_100k", 0.3, 6, None), ("ablation_3layers", 0.3, 3, 10)],
        "exp_name string, dropout double, n_layers int, num_epochs int",
    )
    got = {r.exp_name: r for r in R.config_overlay(over).collect()}
    assert got["baseline_100k"].num_epochs == R.BASE_CONFIG["num_epochs"]  # null -> base
    assert got["ablation_3layers"].num_epochs == 10 and got["ablation_3layers"].n_layers == 3
    assert got["ablation_3layers"].batch_size == R.BASE_CONFIG["batch_size"]  # absent -> base


def test_read_corpus_json_with_id_column(spark, tmp_path):
    from bitext.sources.corpus import read_corpus

    rows = [(10, "早上好", "Good morning"), (11, "谢谢", "Thanks")]
    spark.createDataFrame(rows, "id long, text_zh string, text_en string").coalesce(1).write.json(str(tmp_path / "js"))
    got = sorted(tuple(r) for r in read_corpus(spark, str(tmp_path / "js"), fmt="json", id_col="id").collect())
    assert got == [(10, "早上好", "Good morning"), (11, "谢谢", "Thanks")]


def test_registry_commits_replay_and_resolve(spark, tmp_path):
    from bitext.sources import checkpoints as K

    nan = float("nan")
    epochs = spark.createDataFrame(
        [("a", 1, 0.9), ("a", 2, 0.5), ("a", 3, 0.5), ("a", 4, 0.7), ("b", 1, nan), ("b", 2, nan)],
        "run string, epoch int, val_loss double",
    )
    steps = spark.createDataFrame([("a", e, 10 * e) for e in (1, 2, 3, 4)], "run string, epoch int, global_step long")
    configs = spark.createDataFrame([("a", 96, 1e-4, None)], "exp_name string, batch_size int, lr double, note string")
    path = str(tmp_path / "registry")
    made = K.checkpoint_versions(epochs, steps, configs)
    K.write_versions(made, path, 0)
    once = sorted(map(str, K.read_versions(spark, path).collect()))
    K.write_versions(made, path, 0)  # a replay
    assert sorted(map(str, K.read_versions(spark, path).collect())) == once and len(once) == 6
    a, b = sorted(K.resolve(spark, path).collect(), key=lambda r: r.run)
    # the saved best is the one before the epoch's own update; a tie is no improvement
    assert (a.latest_epoch, a.best_epoch, a.resolved_epoch, a.resolved_kind) == (4, 2, 2, "best")
    assert (a.resolved_step, a.resolved_best_before, a.best_val_loss) == (20, 0.9, 0.5)
    assert a.config == {"batch_size": "96", "lr": "1.0E-4", "note": None}
    # nothing improved on infinity: the latest is loaded; no config and no steps are nulls
    assert (b.best_epoch, b.resolved_epoch, b.resolved_kind, b.resolved_step, b.config) == (None, 2, "latest", None, None)
    # a restart saves epoch 2 again, worse: the later commit counts
    again = made.where("run = 'a' and epoch = 2").withColumn("improved", F.lit(False)).withColumn("val_loss", F.lit(0.95))
    K.write_versions(again, path, 1)
    a = next(r for r in K.resolve(spark, path).collect() if r.run == "a")
    assert (a.best_epoch, a.resolved_commit, a.best_val_loss) == (1, 0, 0.5)
    assert K.read_versions(spark, path).count() == 6


def test_epoch_line(spark):
    e = spark.createDataFrame([("r", 3, 12.345, 1.23456, 2.0, 1e-4)], "run string, epoch int, epoch_time_sec double, train_loss double, val_loss double, learning_rate double")
    assert R.epoch_lines(e).first().line == "Epoch 3 | Time: 12.3s | Train Loss: 1.2346 | Val Loss: 2.0000 | LR: 1.00e-04"


@pytest.mark.parametrize("symbols", [1, 40, 1 << 20])
def test_ngrams_are_counted_in_tasks(spark, monkeypatch, symbols):
    """No n-gram becomes a row to aggregate or spill; rows of one sentence, null ids and null texts count as before."""
    monkeypatch.setattr(M, "SYMBOLS", symbols)
    rows = [(1, "abab 日本 é", "abab日本"), (1, "ba", None), (None, "aaa", "aa"), (2, "", "xyz"), (3, "😀a😀a", "a😀a"), (4, None, None), (None, "ab", "aab")]
    pairs = spark.createDataFrame(rows, "sent_id long, hyp string, ref string")
    stats = M.chrf_stats(pairs)
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Generate" not in M.bleu_stats(pairs)._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for key in {r[0] for r in rows}:
        for n in range(1, 7):
            h, r = (Counter(t[i : i + n] for row in rows if row[0] == key and row[k] for t in ["".join(row[k].split())] for i in range(len(t) - n + 1)) for k in (1, 2))
            if h or r:
                old = want.get(n, (0, 0, 0))
                want[n] = (old[0] + (h.total() if r else 0), old[1] + r.total(), old[2] + (h & r).total())
    assert {x.n: (x.hyp, x.ref, x.match) for x in stats.collect()} == want
    words = M.bleu_stats(pairs).first()
    assert (words.sys_len, words.ref_len, words.m_1, words.t_2) == (7, 5, 0, 2)
