"""The metamodels as tables: classes with their parents, and properties with what they join.

Only what the readers populate is listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The conceptual metamodel. (class), then (property, kind, domain, range, single-valued).
CONCEPTUAL_CLASSES = ("ConceptualModel", "Entity", "Association", "Attribute", "ObservableType")
CONCEPTUAL_PROPERTIES = (
    ("hasEntity", "object", "ConceptualModel", "Entity", False),
    ("hasAssociation", "object", "ConceptualModel", "Association", False),
    ("hasObservableType", "object", "ConceptualModel", "ObservableType", False),
    ("hasAttribute", "object", "Entity|Association", "Attribute", False),
    ("hasParticipant", "object", "Association", "Entity", False),
    ("observableTypeRef", "object", "Attribute", "ObservableType", True),
    ("entityTypeRef", "object", "Attribute", "Entity", True),
    ("modelName", "data", "ConceptualModel", "string", True),
    ("modelDescription", "data", "ConceptualModel", "string", True),
    ("topicDomain", "data", "ConceptualModel", "string", True),
    ("methodBasis", "data", "ConceptualModel", "string", True),
    ("elementName", "data", "Entity|Association|Attribute|ObservableType", "string", True),
    ("typeName", "data", "Attribute", "string", True),
)
# The message metamodel. (class, parents), then (property, parent, domain, range).
MESSAGE_CLASSES = (
    ("DataModel", ()),
    ("ConceptualDataModel", ("DataModel",)),
    ("LogicalDataModel", ("DataModel",)),
    ("PlatformDataModel", ("DataModel",)),
    ("BasisEntity", ("ConceptualElement",)),
    ("ConceptualEntity", ("ConceptualElement", "ComposableElement")),
    ("ConceptualObservable", ("ConceptualElement",)),
    ("ConceptualComposition", ("Characteristic",)),
    ("LogicalEntity", ("LogicalElement", "ComposableElement")),
    ("LogicalMeasurement", ("LogicalElement",)),
    ("LogicalValueType", ("LogicalElement",)),
    ("LogicalUnit", ("LogicalElement",)),
    ("LogicalCoordinateSystem", ("LogicalElement",)),
    ("LogicalMeasurementSystem", ("LogicalElement",)),
    ("PlatformEntity", ("PlatformElement", "ComposableElement")),
    ("PlatformComposition", ("Characteristic",)),
    ("PlatformDataType", ("PlatformElement",)),
    ("PlatformPrimitive", ("PlatformDataType",)),
    ("Cardinality", ()),
)
MESSAGE_PROPERTIES = (
    ("hasConceptualModel", None, "DataModel", "ConceptualDataModel"),
    ("hasLogicalModel", None, "DataModel", "LogicalDataModel"),
    ("hasPlatformModel", None, "DataModel", "PlatformDataModel"),
    ("specializes", None, "NamedElement", "NamedElement"),
    ("realizes", None, "NamedElement", "NamedElement"),
    ("logicalEntityRealizes", "realizes", "LogicalEntity", "ConceptualEntity"),
    ("measurementRealizes", "realizes", "LogicalMeasurement", "ConceptualObservable"),
    ("platformEntityRealizes", "realizes", "PlatformEntity", "LogicalEntity"),
    ("platformCompositionRealizes", "realizes", "PlatformComposition", "LogicalMeasurement"),
    ("hasBasisEntity", None, "ConceptualDataModel", "BasisEntity"),
    ("hasConceptualEntity", None, "ConceptualDataModel", "ConceptualEntity"),
    ("hasConceptualObservable", None, "ConceptualDataModel", "ConceptualObservable"),
    ("hasConceptualComposition", "hasComposition", "ConceptualEntity", "ConceptualComposition"),
    ("hasPlatformComposition", "hasComposition", "PlatformEntity", "PlatformComposition"),
    ("compositionTarget", None, "ConceptualComposition", "ComposableElement|ConceptualObservable"),
    ("appliesTo", None, "ConceptualObservable", "ConceptualEntity"),
    ("hasLogicalEntity", None, "LogicalDataModel", "LogicalEntity"),
    ("hasLogicalMeasurement", None, "LogicalDataModel", "LogicalMeasurement"),
    ("measurementValueType", None, "LogicalMeasurement", "LogicalValueType"),
    ("measurementUnit", None, "LogicalMeasurement", "LogicalUnit"),
    ("measurementSystem", None, "LogicalMeasurement", "LogicalMeasurementSystem"),
    ("hasPlatformEntity", None, "PlatformDataModel", "PlatformEntity"),
    ("platformCompositionTarget", None, "PlatformComposition", "PlatformDataType"),
    ("hasCardinality", None, "Characteristic", "Cardinality"),
)


def class_parents(spark: SparkSession) -> DataFrame:
    """(class, parent), a row for each parent; null where a class has none."""
    rows = [(c, p) for c, parents in MESSAGE_CLASSES for p in parents or (None,)]
    return spark.createDataFrame(rows, "class string, parent string")


def property_parents(spark: SparkSession) -> DataFrame:
    """(property, parent, domain, range); several domains or ranges are parted by a bar."""
    return spark.createDataFrame(list(MESSAGE_PROPERTIES), "property string, parent string, domain string, range string")


def conceptual_properties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONCEPTUAL_PROPERTIES), "property string, kind string, domain string, range string, single boolean")


def with_superproperties(assertions: DataFrame) -> DataFrame:
    """Assertions and what their properties' parents say of the same pair."""
    up = property_parents(assertions.sparkSession).filter("parent IS NOT NULL").select(F.col("property").alias("predicate"), "parent")
    more = assertions.join(F.broadcast(up), "predicate").withColumn("predicate", F.col("parent")).select(*assertions.columns)
    return assertions.unionByName(more)
