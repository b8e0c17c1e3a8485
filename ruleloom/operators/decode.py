"""Encoded payloads: decoded layers, their chains, previews and criticality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom import constants as K
from ruleloom.functions import text as T

MAX_LAYERS = 3


def base64_bytes(s: Column) -> Column:
    """Decoded bytes of padded base64, null where the shape is wrong."""
    shaped = (F.char_length(s) % 4 == 0) & s.rlike(r"^[A-Za-z0-9+/]+={0,2}$")
    return F.when(shaped, F.try_to_binary(s, F.lit("base64")))


def hex_bytes(s: Column) -> Column:
    shaped = (F.char_length(s) % 2 == 0) & s.rlike("^[0-9a-fA-F]+$")
    return F.when(shaped, F.try_to_binary(s, F.lit("hex")))


def utf8(data: Column) -> Column:
    """Bytes as text, null where they are not valid UTF-8."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def base64_strings(df: DataFrame, column: str) -> DataFrame:
    """Decoded base64 runs that hold at least 10 bytes of mostly printable text."""
    kept = [c for c in df.columns if c != column]
    hits = F.regexp_extract_all(F.col(column), F.lit(K.BASE64_RUN_RE), F.lit(0))
    found = df.select(*kept, F.explode(hits).alias("encoded")).withColumn("value", utf8(base64_bytes(F.col("encoded"))))
    printable = T.count_regex(F.col("value"), r"[\x20-\x7E]")
    return found.filter(
        F.col("value").isNotNull()
        & (F.octet_length("value") >= 10)
        & (printable / F.nullif(F.octet_length("value"), F.lit(0)) > 0.7)
    )


def _one_layer(s: Column) -> Column:
    """Zero or one struct<encoding, data>: base64 if it decodes, else hex."""
    tries = F.array(
        F.struct(F.lit("base64").alias("encoding"), F.when(F.octet_length(s) >= 24, base64_bytes(s)).alias("data")),
        F.struct(F.lit("hex").alias("encoding"), F.when(F.octet_length(s) >= 48, hex_bytes(s)).alias("data")),
    )
    return F.slice(F.filter(tries, lambda t: t["data"].isNotNull()), 1, 1)


def decode_layers(strings: DataFrame) -> DataFrame:
    """Layers of (…, value, chain, depth), each decoded from the one before.

    A layer is base64 (at least 24 characters) or hex (at least 48), tried in that
    order. The depth is fixed, so this is three projections, not a loop over data.
    """
    keys = [c for c in strings.columns if c != "value"]
    step = strings.withColumn("chain", F.array().cast("array<string>"))
    layers: list[DataFrame] = []
    for depth in range(1, MAX_LAYERS + 1):
        # The generator keeps each layer's decoding from being repeated in the next one.
        step = step.select(*keys, "chain", F.explode(_one_layer(F.btrim("value", F.lit(" \t\r\n")))).alias("hit")).select(
            *keys,
            F.concat("chain", F.array("hit.encoding")).alias("chain"),
            utf8(F.col("hit.data")).alias("value"),
            F.hex(F.substring("hit.data", 1, 16)).alias("head_hex"),
            F.octet_length("hit.data").cast("bigint").alias("n_bytes"),
            F.lit(depth).alias("depth"),
        )
        layers.append(step)
    return reduce(lambda a, b: a.unionByName(b), layers)


def payloads(strings: DataFrame) -> DataFrame:
    """The last layer of every chain whose first decoded text has 24 bytes or more."""
    layers = decode_layers(strings)
    keys = [c for c in strings.columns if c != "value"]
    fields = ["value", "chain", "depth", "head_hex", "n_bytes"]
    last = layers.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), "depth").alias("last"),
        F.min_by("n_bytes", "depth").alias("first_bytes"),
    )
    return last.filter(F.col("first_bytes") >= 24).select(
        *keys, *[F.col(f"last.{c}").alias(c) for c in fields], T.preview(F.col("last.value")).alias("preview")
    )


def payload_crit(value: Column, head_hex: Column) -> Column:
    """Shell commands and executables are hostile, addresses notable, the rest suspicious."""
    return (
        F.when(T.starts_with_any(head_hex, K.EXECUTABLE_MAGIC), K.HOSTILE)
        .when(value.isNull(), K.SUSPICIOUS)
        .when(T.has_shell_command(value) | T.has_sql(value), K.HOSTILE)
        .when(T.is_script_text(value), K.SUSPICIOUS)
        .when(T.string_kind(value).isin("url", "ip", "email"), K.NOTABLE)
        .otherwise(K.SUSPICIOUS)
    )


def payload_type(value: Column, head_hex: Column) -> Column:
    out = F.when(head_hex.startswith("7F454C46"), "elf").when(head_hex.startswith("4D5A"), "pe")
    out = out.when(T.starts_with_any(head_hex, ("FEEDFACE", "FEEDFACF", "CAFEBABE")), "macho")
    python = T.contains_any(value, ("import ", "def ", "class "))
    shell = T.starts_with_any(value, K.SCRIPT_SHEBANGS)
    return out.when(shell, "shell").when(python, "python").otherwise("unknown")


def payload_findings(found: DataFrame) -> DataFrame:
    """One finding per file and chain; script or program payloads are suspicious."""
    kind = payload_type(F.col("value"), F.col("head_hex"))
    crit = F.when(kind.isin("python", "shell", "elf", "macho", "pe"), K.SUSPICIOUS).otherwise(K.NOTABLE)
    ids = F.concat(F.lit("metadata/encoded-payload/"), F.array_join("chain", "-"))
    first = found.select("file_id", "offset", ids.alias("rule_id"), crit.alias("crit"), "preview")
    return first.groupBy("file_id", "rule_id").agg(
        F.min_by("crit", F.struct("offset", "preview")).alias("crit"),
        F.min_by("preview", F.struct("offset", "preview")).alias("preview"),
        F.lit(0.9).alias("conf"),
    )
