"""Temporal evaluation on Spark: folds, walk-forward runs, studies and online replay over DataFrames."""

from chronofold.functions.metrics import ClassificationProfile, EvaluationProfile, GroupMedianModel, LinearModel, MajorityModel, MeanModel, Metric, NativeModel, OrdinalClassificationProfile, RankingProfile, RegressionProfile, ResolvedEvaluationProfile
from chronofold.operators.bands import PredictionBandContext, PredictionBandScenarioResult, estimate_prediction_band_by_fold
from chronofold.operators.online import OnlineRetrainTrigger, OnlineRunResult, OnlineTemporalRunner, OnlineUpdatePolicy, OnlineUpdatePolicyStudy, OnlineUpdatePolicyStudyResult, OnlineUpdateStrategy, PartialFitUpdateStrategy, RefitUpdateStrategy
from chronofold.operators.reporting import SimulationChartData, SimulationSummary
from chronofold.operators.runner import AlwaysRetrain, DriftBasedRetrain, FunctionRetrainPolicy, NeverRetrain, PeriodicRetrain, RetrainContext, RetrainPolicy, WalkForwardRunner, WalkForwardRunResult
from chronofold.operators.splitting import BatchSimulationResult, SimulationCampaign, SimulationResult, SimulationVariant, TemporalBacktestSplitter, TemporalSimulation, TimeSplit, WalkForwardPolicy
from chronofold.operators.studies import DriftMonitoringPolicy, PerformanceDecayPolicy, PerformanceDecayResult, RollingTrainHistoryPolicy, RollingTrainHistoryResult, TrainGrowthPolicy, TrainGrowthResult, TrainHistoryPolicy
from chronofold.operators.systems import SystemEvaluationResult, SystemRunResult, SystemUpdateResult, TemporalSystemRunner, UpdateableSystem
from chronofold.plans.plan import PartitionPlan, PlannedFold, SimulationPlan
from chronofold.plans.spec import FeatureLookbackSpec, SegmentBoundaries, SizeSpec, TemporalPartitionSpec, TemporalSemanticsSpec
from chronofold.sources.adapters import PartitionEngineMetadata

__version__ = "0.1.0"

__all__ = [n for n in dir() if n[0].isupper() or n in ("estimate_prediction_band_by_fold", "__version__")]
