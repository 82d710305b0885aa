"""The harmonised entity types, and native labels of other schemes mapped to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tags import SPAN, entity_tags

#: Version, and (type, tier, class, special category of data) in their published order.
VERSION = "0.2.0"
ENTITIES = (
    ("PERSON", "core", "direct", False),
    ("ADDRESS", "core", "quasi", False),
    ("EMAIL", "core", "direct", False),
    ("PHONE", "core", "direct", False),
    ("URL", "core", "quasi", False),
    ("DATE", "core", "quasi", False),
    ("ACCOUNT_ID", "core", "direct", False),
    ("SECRET", "core", "direct", False),
    ("NATIONAL_ID", "core", "direct", False),
    ("MRN", "clinical", "direct", False),
    ("HEALTH_CONDITION", "clinical", "quasi", True),
    ("PROVIDER", "clinical", "quasi", False),
    ("FACILITY", "clinical", "quasi", False),
    ("CASE_NUMBER", "legal", "direct", False),
    ("COURT", "legal", "quasi", False),
    ("STATUTE_REF", "legal", "quasi", False),
    ("ORG_PARTY", "legal", "quasi", False),
    ("COMPANY_ID", "legal", "direct", False),
)
#: Fixed values: (type, scheme, native labels).
CROSSWALK = (
    ("PERSON", "openai", "private_person"),
    ("PERSON", "ai4privacy", "GIVENNAME SURNAME FIRSTNAME LASTNAME MIDDLENAME"),
    ("PERSON", "hipaa", "names"),
    ("PERSON", "mapa", "PERSON"),
    ("PERSON", "openmed", "FIRSTNAME LASTNAME MIDDLENAME PREFIX"),
    ("PERSON", "tabularisai", "FIRSTNAME LASTNAME MIDDLENAME PREFIX"),
    ("PERSON", "tab", "PERSON"),
    ("ADDRESS", "openai", "private_address"),
    ("ADDRESS", "ai4privacy", "STREET CITY ZIPCODE BUILDINGNUM"),
    ("ADDRESS", "hipaa", "geographic_subdivisions"),
    ("ADDRESS", "mapa", "ADDRESS"),
    ("ADDRESS", "openmed", "STREET CITY ZIPCODE BUILDINGNUMBER COUNTY STATE SECONDARYADDRESS GPSCOORDINATES ORDINALDIRECTION"),
    ("ADDRESS", "tabularisai", "ADDRESS BUILDING_NUMBER CITY STATE STREET POSTAL_CODE COUNTRY LATITUDE LONGITUDE"),
    ("ADDRESS", "tab", "LOC"),
    ("EMAIL", "openai", "private_email"),
    ("EMAIL", "ai4privacy", "EMAIL"),
    ("EMAIL", "openmed", "EMAIL"),
    ("EMAIL", "tabularisai", "EMAIL"),
    ("PHONE", "openai", "private_phone"),
    ("PHONE", "ai4privacy", "TELEPHONENUM"),
    ("PHONE", "openmed", "PHONE"),
    ("PHONE", "tabularisai", "PHONE_NUMBER"),
    ("URL", "openai", "private_url"),
    ("URL", "openmed", "URL"),
    ("URL", "tabularisai", "URL"),
    ("DATE", "openai", "private_date"),
    ("DATE", "ai4privacy", "DATE TIME"),
    ("DATE", "hipaa", "dates"),
    ("DATE", "openmed", "DATE DATEOFBIRTH TIME"),
    ("DATE", "tabularisai", "DOB"),
    ("DATE", "tab", "DATETIME"),
    ("ACCOUNT_ID", "openai", "account_number"),
    ("ACCOUNT_ID", "ai4privacy", "ACCOUNTNUM TAXNUM CREDITCARDNUMBER"),
    ("ACCOUNT_ID", "hipaa", "account_numbers"),
    ("ACCOUNT_ID", "openmed", "IBAN BANKACCOUNT BIC CREDITCARD CREDITCARDISSUER CVV PIN MASKEDNUMBER ACCOUNTNAME BITCOINADDRESS ETHEREUMADDRESS LITECOINADDRESS VIN VRM IMEI MACADDRESS IPADDRESS USERNAME USERAGENT"),
    ("ACCOUNT_ID", "tabularisai", "ACCOUNT_NUMBER CREDIT_CARD_NUMBER IBAN TAX_ID DEVICE_ID IP_ADDRESS MAC_ADDRESS USERNAME"),
    ("SECRET", "openai", "secret"),
    ("SECRET", "ai4privacy", "PASSWORD"),
    ("SECRET", "openmed", "PASSWORD"),
    ("SECRET", "tabularisai", "PASSWORD"),
    ("NATIONAL_ID", "ai4privacy", "IDCARDNUM SOCIALNUM PASSPORTNUM DRIVERLICENSENUM"),
    ("NATIONAL_ID", "hipaa", "ssn"),
    ("NATIONAL_ID", "openmed", "SSN"),
    ("NATIONAL_ID", "tabularisai", "NATIONAL_ID PASSPORT_NUMBER DRIVER_LICENSE HEALTH_INSURANCE_ID"),
    ("MRN", "hipaa", "medical_record_numbers"),
    ("HEALTH_CONDITION", "openmed", "DIAGNOSES MEDICATION"),
    ("HEALTH_CONDITION", "tabularisai", "HEALTH_CONDITION"),
    ("CASE_NUMBER", "mapa", "AMOUNT"),
    ("CASE_NUMBER", "tab", "CODE"),
    ("ORG_PARTY", "mapa", "ORGANIZATION"),
    ("ORG_PARTY", "tabularisai", "COMPANY_NAME"),
    ("ORG_PARTY", "tab", "ORG"),
    # schemes without a label for a type have no row
)


def entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITIES, "name string, tier string, class string, special boolean")


def crosswalk(spark: SparkSession) -> DataFrame:
    """(scheme, native, name), one row for each native label of a scheme."""
    rows = spark.createDataFrame(CROSSWALK, "name string, scheme string, natives string")
    return rows.select("scheme", F.explode(F.split("natives", " ")).alias("native"), "name")


def conflicts(walk: DataFrame) -> DataFrame:
    """Native labels that a scheme maps to more than one type; must be empty."""
    return walk.groupBy("scheme", "native").agg(F.count_distinct("name").alias("names")).filter("names > 1")


def bioes_labels(types: DataFrame) -> DataFrame:
    """(label): O, and B, I, E and S of each type."""
    return types.select(F.explode(F.transform(F.array(*map(F.lit, "BIES")), lambda k: F.concat(k, F.lit("-"), F.col("name")))).alias("label")).unionByName(types.sparkSession.createDataFrame([("O",)], "label string"))


def special_types(types: DataFrame) -> DataFrame:
    return types.filter("special").select("name")


def map_labels(df: DataFrame, walk: DataFrame) -> DataFrame:
    """``df`` (scheme, native, ..) with ``name``, null where the label is unknown; the table of labels is broadcast (it has some 100 rows)."""
    return df.join(F.broadcast(walk.select("scheme", "native", "name")), ["scheme", "native"], "left")


def _native_map(scheme: str) -> Column:
    pairs = [F.lit(x) for name, s, natives in CROSSWALK if s == scheme for native in natives.split() for x in (native, name)]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def mapped_entities(entities: Column, scheme: str) -> Column:
    """Entities (start, end, label) of a scheme under harmonised labels; those of unknown labels go."""
    named = F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), _native_map(scheme)[e["label"]].alias("label")).cast(SPAN))
    return F.filter(named, lambda e: e["label"].isNotNull())


def native_tags(tokens: Column, entities: Column, scheme: str) -> Column:
    """Tags of a scheme's entities over tokens."""
    return entity_tags(tokens, mapped_entities(entities, scheme))
