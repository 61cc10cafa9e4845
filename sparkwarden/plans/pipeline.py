"""The stages from ledger to report, in order: each takes what earlier ones made and is written if a folder is given."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..operators import alerts, evaluation, features, ml, report, rules, triage
from ..operators.graph import AccountGraph
from ..operators.iterate import cut
from ..sources import ledger, sinks

STAGES = ("data_loading", "rule_engine", "graph_analysis", "feature_engineering", "ml_scoring", "alert_generation", "llm_triage", "compliance_reporting")
#: What can be asked for by name: the stages up to the one that makes it. Features, models and alerts need the graph's columns.
TARGETS = {
    "rules": STAGES[:2], "graph": (STAGES[0], STAGES[2]), "features": STAGES[:4], "train": STAGES[:5],
    "alerts": STAGES[:6], "triage": STAGES[:7], "report": STAGES, "full-pipeline": STAGES, "evaluate": STAGES[:6],
}
log = logging.getLogger("sparkwarden")


class Pipeline:
    """``results`` holds what the stages made, ``status`` and ``timings`` how they went, ``failed`` the stage that raised.

    ``model`` answers triage prompts; ``connect``, if given, makes it when triage begins. Where that raises, all alerts go to
    manual review.
    """

    def __init__(
        self, spark: SparkSession, config: Config = Config(), folder: str | None = None, model: Callable[[str, str], str] = triage.offline_model, use_graph: bool = True,
        connect: Callable[[], Callable[[str, str], str]] | None = None,
    ):
        config.validate()
        self.spark, self.config, self.folder, self.model, self.use_graph, self.connect = spark, config, folder, model, use_graph, connect
        self.results: dict = {}
        self.status = dict.fromkeys(STAGES, "pending")
        self.timings: dict[str, float] = {}
        self.failed: str | None = None

    def run(self, source: DataFrame | None = None, stages: tuple[str, ...] = STAGES, skip_llm: bool = False) -> dict:
        """Stages in order. ``source``: a canonical ledger, else a synthetic sample. A name that is no stage is passed over with a warning."""
        for name in stages:
            if name not in STAGES:
                log.warning("no stage %r: passed over", name)
            elif not (skip_llm and name == "llm_triage"):
                self.run_stage(name, source)
        return self.results

    def run_target(self, target: str, source: DataFrame | None = None) -> dict:
        """The stages that a name of TARGETS stands for; ``evaluate`` adds what evaluate() gives. Another name raises ValueError."""
        if target not in TARGETS:
            raise ValueError(f"target {target!r} is none of {', '.join(TARGETS)}")
        self.run(source, TARGETS[target])
        if target == "evaluate":
            self.results |= {f"evaluation_{k}": v for k, v in self.evaluate().items()}
        return self.results

    def run_stage(self, name: str, source: DataFrame | None = None):
        if name not in STAGES:
            raise ValueError(f"no stage {name!r}")
        began, self.status[name] = time.time(), "running"
        try:
            made = getattr(self, f"_{name}")(*([source] if name == "data_loading" else []))
        except Exception:
            self.status[name], self.failed = "failed", name
            raise
        self.status[name], self.timings[name] = "completed", time.time() - began
        if self.folder:
            for key, value in made.items():
                if isinstance(value, (DataFrame, dict)):
                    sinks.save_stage(value, self.folder, key, self.spark)
        self.results |= made
        return made

    def _need(self, key: str):
        if key not in self.results:
            raise RuntimeError(f"{key} is not there: run its stage first")
        return self.results[key]

    def _data_loading(self, source: DataFrame | None) -> dict:
        df = source if source is not None else ledger.synthetic(self.spark, seed=self.config.model.seed)
        df = cut(ledger.with_split(df, self.config.model.test_share))
        return {"transactions": df, "profile": ledger.profile_amounts(df)}

    def _rule_engine(self) -> dict:
        scored = cut(rules.evaluate(self._need("transactions"), self.config.rules))
        return {"scored": scored, "rule_statistics": rules.statistics(scored, self.config.rules)}

    def _graph_analysis(self) -> dict:
        df = self._need("transactions")
        graph = AccountGraph(self.config.graph).build(df)
        return {"graph": graph, "graph_features": cut(graph.features(df)), "suspicious": cut(graph.suspicious()), "central_accounts": graph.central(), "graph_summary": graph.summary()}

    def _feature_engineering(self) -> dict:
        return {"features": cut(features.engineer(self._need("transactions"), self._need("scored"), self.results.get("graph_features") if self.use_graph else None))}

    def _ml_scoring(self) -> dict:
        labels = self._need("transactions").select("transaction_id", F.col("is_laundering").alias("label"), "is_train")
        rows = self._need("features").join(labels, "transaction_id")
        # the last fifth of the training rows is held out for the choice of model and threshold
        fit = rows.where("is_train").drop("is_train")
        fold = F.pmod(F.xxhash64("transaction_id", F.lit(self.config.model.seed)), F.lit(5))
        trained = ml.train(fit.where(fold != 0), fit.where(fold == 0), self.config.model)
        return {"model": trained, "ml_scores": cut(trained.predict_proba(rows.drop("is_train")))}

    def _alert_generation(self) -> dict:
        graph = self.results.get("graph")
        made = alerts.generate(
            self._need("scored"), self.results.get("ml_scores"), self.results.get("graph_features"), self.results.get("suspicious"), graph and graph.communities(), graph and graph.in_cycle(), cfg=self.config.alerts
        )
        made = cut(made)
        return {"alerts": made, "alert_statistics": alerts.statistics(made)}

    def _llm_triage(self) -> dict:
        cfg, made = self.config.triage, self._need("alerts")
        try:
            model = self.connect() if self.connect else self.model
        except Exception as e:  # the caller's code
            log.warning("no triage model: %s", e)
            return {"triage": cut(triage.unanswered(made, str(e), cfg))}
        return {"triage": cut(triage.triage(triage.chosen(made, cfg.max_alerts), model, cfg))}

    def _compliance_reporting(self) -> dict:
        sections = report.package(self._need("alerts"), self.results.get("triage"))
        page = report.page("Suspicious activity", sections)
        if self.folder:
            sinks.write_text(self.spark, page, f"{self.folder}/report.html")
        return {f"report_{k}": v for k, v in sections.items()} | {"report_page": page}

    def evaluate(self) -> dict[str, DataFrame]:
        """Metrics of the held-out rows by system, of the rules, and of the alerts against labelled senders."""
        test = self._need("transactions").where("not is_train").select("transaction_id")
        scored = self._need("scored").join(self._need("ml_scores"), "transaction_id").join(test, "transaction_id", "left_semi")
        truth = self._need("transactions").where("is_laundering = 1").select(F.col("from_id").alias("entity_id"))
        out = {"systems": evaluation.compare_systems(scored), "rules": evaluation.rule_report(scored), "rule_overlap": evaluation.rule_overlap(scored), "alerts": evaluation.alert_report(self._need("alerts"), truth)}
        if "triage" in self.results:
            out["triage"] = evaluation.triage_report(self.results["triage"])
        return out
