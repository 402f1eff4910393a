"""The trial registry: nested JSON, one document for each trial; only the paths that are read are declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_DATE = "struct<date:string>"
SCHEMA = f"""
protocolSection struct<
  identificationModule: struct<nctId:string, officialTitle:string, briefTitle:string>,
  statusModule: struct<completionDateStruct:{_DATE}, resultsFirstPostDateStruct:{_DATE}>,
  designModule: struct<enrollmentInfo:struct<count:bigint, type:string>, designInfo:struct<allocation:string, interventionModel:string>>,
  conditionsModule: struct<conditions:array<string>, keywords:array<string>>,
  referencesModule: struct<references:array<struct<citation:string>>>,
  eligibilityModule: struct<eligibilityCriteria:string, healthyVolunteers:boolean>,
  contactsLocationsModule: struct<locations:array<struct<country:string>>>,
  armsInterventionsModule: struct<armGroups:array<struct<label:string, type:string, description:string>>>,
  outcomesModule: struct<primaryOutcomes:array<struct<measure:string, timeFrame:string, description:string>>>>,
derivedSection struct<conditionBrowseModule:struct<meshes:array<struct<term:string>>, ancestors:array<struct<term:string>>>>,
resultsSection struct<
  baselineCharacteristicsModule: struct<measures:array<struct<title:string, description:string>>>,
  outcomeMeasuresModule: struct<outcomeMeasures:array<struct<
    type:string, title:string, timeFrame:string, description:string, paramType:string, dispersionType:string, unitOfMeasure:string,
    groups:array<struct<id:string, title:string, description:string>>,
    denoms:array<struct<counts:array<struct<groupId:string, value:string>>>>,
    classes:array<struct<categories:array<struct<measurements:array<struct<groupId:string, value:string, spread:string, lowerLimit:string, upperLimit:string>>>>>>>>>>,
hasResults boolean
"""


def schema() -> StructType:
    return StructType.fromDDL(SCHEMA)


def read_trials(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each JSON document, a file or, with `lines`, a line each; what a document lacks is NULL."""
    return spark.read.schema(schema()).option("multiLine", str(not lines).lower()).option("recursiveFileLookup", "true").json(path)
