"""Table schemas, the ontology as data, and job parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Node, edge and evidence vocabularies, and the ontology's domains and ranges.
NODE_TYPES = ("entity", "process", "rule", "policy", "event", "system", "role")
EDGE_TYPES = ("OPERATES_ON", "VALIDATES", "CALCULATES", "TRIGGERS", "EXECUTES", "DEPENDS_ON", "GOVERNS", "IMPLEMENTED_IN", "PART_OF")
STATUSES = ("active", "conflicted", "stale", "deprecated")
SOURCE_TYPES = ("code", "document", "interview")
STANCES = ("supports", "contradicts")
ONTOLOGY = {
    "OPERATES_ON": (("rule",), ("entity",)),
    "VALIDATES": (("rule",), ("process", "entity")),
    "CALCULATES": (("rule",), ("entity",)),
    "TRIGGERS": (("event", "process"), ("process", "event")),
    "EXECUTES": (("role", "system"), ("process",)),
    "DEPENDS_ON": (("process", "rule"), ("process", "rule", "entity", "system")),
    "GOVERNS": (("policy",), ("rule", "process")),
    "IMPLEMENTED_IN": (("rule", "process"), ("system",)),
    "PART_OF": (("process", "entity"), ("process", "entity")),
}
# Confidence in hundredths.
BASE_CONFIDENCE = {"code": 90, "document": 70, "interview": 60}
VALIDATED_CONFIDENCE, SOURCE_BONUS, CEILING, REVIEW_THRESHOLD = 95, 5, 99, 70
# Weight of a hop by edge type; other types have 0.75.
EDGE_WEIGHTS = {"DEPENDS_ON": 1.0, "GOVERNS": 1.0, "TRIGGERS": 1.0, "VALIDATES": 0.9, "CALCULATES": 0.9, "EXECUTES": 0.85, "OPERATES_ON": 0.75, "PART_OF": 0.75, "IMPLEMENTED_IN": 0.5}
AUTO_THRESHOLD, GRAY_THRESHOLD, MAX_EXCERPT, SCHEMA_VERSION = 0.92, 0.75, 300, 1

EVIDENCE_FIELDS = "locator string, excerpt string, validated_by string"
BATCH_SCHEMA = (
    "run_id string, source_type string, schema_version int, extractor struct<name:string,model:string,prompt_version:string>, "
    "nodes array<struct<mention:string,candidate_id:string,type:string,name:string,description:string,attrs:string,"
    "evidence:struct<locator:string,excerpt:string,validated_by:string>>>, "
    "edges array<struct<type:string,source_mention:string,target_mention:string,stance:string,attrs:string,"
    "evidence:struct<locator:string,excerpt:string,validated_by:string>>>"
)
DOCUMENT_SCHEMA = (
    "type string, id string, name string, status string, aliases array<string>, attrs string, description string, schema_version int, "
    "evidence array<struct<source_type:string,locator:string,excerpt:string,stance:string,validated_by:string,run:string>>, "
    "edges array<struct<type:string,target:string,confidence:double,status:string,attrs:string,"
    "evidence:array<struct<source_type:string,locator:string,excerpt:string,stance:string,validated_by:string,run:string>>>>"
)


@dataclass(frozen=True)
class RetrievalConfig:
    """Knobs of retrieval; see `operators.retrieve`."""

    mode: str = "manual"
    enabled: dict[str, bool] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: {"lexical": 1.0, "prf": 0.5, "semantic": 0.9, "multivec": 1.0})
    limit: int = 15
    depth: int = 2
    decay: float = 0.6
    hub_penalty: float = 0.3
    restart: float = 0.15
    blend: float = 0.65
    mmr_lambda: float = 0.7
    feedback_docs: int = 8
    feedback_terms: int = 5


def ontology(spark: SparkSession) -> DataFrame:
    """edge_type, source_type, target_type: all permitted triples (PART_OF joins equal types only). 33 rows at most."""
    rows = [(e, s, t) for e, (ss, ts) in ONTOLOGY.items() for s in ss for t in ts if e != "PART_OF" or s == t]
    return spark.createDataFrame(rows, "edge_type string, source_type string, target_type string")
