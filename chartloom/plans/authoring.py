"""Feature definitions of a new entity: proposed in batches, filled, shown, united with the base list, saved.

One batch is one reply of a generator, read on the driver; definitions are settings, not data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import proposal_prompt
from ..functions.text import fenced_json
from ..operators import definitions
from ..providers import Generator
from ..sources.features import features_from_list, load_features, save_entity_features, to_list


@dataclass
class Authoring:
    """base: the features that every entity has, as a list or a JSON path.

    filter_known leaves out proposals that bear a known name; by default only the prompt asks for that.
    """

    spark: SparkSession
    base: str | list[dict]
    generator: Generator
    filter_known: bool = False
    suggested: list[str] = field(default_factory=list)
    entity: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.definitions = load_features(self.spark, self.base, validate=False)
        self.latest = self.definitions.limit(0)

    def _suggested(self) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in self.suggested], "name string")

    def _listed(self, names: DataFrame) -> str:
        return definitions.sorted_names(names).first()["names"]

    def prompt(self, entity: str, areas: str = "", batch_number: int = 1) -> str:
        span = self.spark.range(1).select(definitions.batch_range(F.lit(batch_number)).alias("r")).first()["r"]
        known = self.definitions.select(definitions.base_name(F.lower(F.coalesce("name", F.lit("")))).alias("name"))
        said = definitions.suggested_names(self.definitions).union(self._suggested())
        return proposal_prompt(entity, areas, batch_number, span["first"], span["last"], self._listed(known), self._listed(said))

    def propose(self, entity: str, areas: str = "", batch_number: int = 1, previously_suggested: list[str] | None = None) -> DataFrame:
        """One row: batch_number, the new definitions, how many there are in all, and what went wrong."""
        self.suggested += [x.lower() for x in previously_suggested or []]
        self.latest, error = self.definitions.limit(0), None
        try:
            reply = self.generator.generate(self.prompt(entity, areas, batch_number))
            body = self.spark.createDataFrame([(reply,)], "t string").select(fenced_json(F.col("t"))).first()[0]
            new = features_from_list(self.spark, json.loads(body).get("entity_specific_features", []))
            if self.filter_known:
                new = definitions.without_known(new, definitions.names_to_avoid(self.definitions, self._suggested()))
            filled = to_list(definitions.generated_defaults(definitions.numbered(new, self.definitions)))
            self.latest = features_from_list(self.spark, filled)
            self.entity += filled
            self.suggested += [f["name"].split("_")[0] for f in filled]
        except json.JSONDecodeError:
            error = "The proposal couldn't be read."
        except Exception as e:  # a generator may fail in any way; that costs its batch alone
            error = f"No features: {e}"
        batch = definitions.batch_of(self.latest, batch_number)
        return batch.withColumn("entity_feature_count", F.lit(len(self.entity))).withColumn("error", F.lit(error).cast("string"))

    def show(self) -> str:
        """The latest batch as shown to a reader."""
        return definitions.display_batch(self.latest).first()["shown"]

    def combined(self) -> DataFrame:
        """The base list and all that was proposed."""
        return definitions.combined(self.definitions, features_from_list(self.spark, self.entity))

    def save(self, path: str) -> bool:
        return save_entity_features(self.combined(), path)
