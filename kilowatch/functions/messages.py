"""Columns over the text of raw messages."""

from pyspark.sql import functions as F

from kilowatch.schema import NUMERIC_MESSAGE, TEXT_MESSAGE
from kilowatch.vocabulary import ENERGY_METER, MINUTE_SUFFIX


def message_text(value="value"):
    """Payload bytes as text."""
    return F.col(value).cast("string")


def once(column, use):
    """`use(column)` with the column evaluated a single time however often `use` refers to it."""
    return F.get(F.transform(F.array(column), use), F.lit(0))


def parsed(text, salvage=False):
    """The message as (ts, params); one value that is no number voids the whole map unless salvaged."""
    if not salvage:
        return F.from_json(text, NUMERIC_MESSAGE)
    return once(
        F.from_json(text, TEXT_MESSAGE),
        lambda message: F.struct(
            message["ts"].alias("ts"),
            # A bare NaN or Infinity comes as text in quotes.
            F.transform_values(message["params"], lambda _, number: F.btrim(number, F.lit('"')).try_cast("double")).alias("params"),
        ),
    )


def strictly_parsed(text):
    """The text as the first of two array elements, so the parser has to reach its end and notices trailing garbage."""
    return F.from_json(
        F.concat(F.lit("["), text, F.lit(',{"_end":true}]')),
        "ARRAY<STRUCT<ts: STRING, _end: BOOLEAN>>",
        {"allowSingleQuotes": "false"},
    )


def one_object(pair):
    """Whether a strictly parsed text is one well-formed JSON object."""
    return F.coalesce(F.get(pair, F.lit(1))["_end"] & F.get(pair, F.lit(0)).isNotNull(), F.lit(False))


def is_object(text):
    return once(strictly_parsed(text), one_object)


def enveloped(text):
    """The text if it is a JSON object, else `{"raw": text}`."""
    return F.when(is_object(text), text).otherwise(F.to_json(F.struct(text.alias("raw"))))


def message_time(text):
    """`ts` of the message, empty when it has none or is no JSON object."""
    return once(
        strictly_parsed(text), lambda pair: F.coalesce(F.when(one_object(pair), F.get(pair, F.lit(0))["ts"]), F.lit(""))
    )


def on_the_minute(text):
    """Whether the message's `ts` ends like a full minute.

    Only a text that holds the ending literally or spells characters as escapes can qualify; the rest is not parsed.
    """
    possible = text.contains(MINUTE_SUFFIX + '"') | text.contains("\\u")
    return possible & message_time(text).endswith(MINUTE_SUFFIX)


def unusable(text, salvage=False, drop_nan=False, keep_malformed=True, meter_class=ENERGY_METER):
    """Why a message gives no reading, or null if it gives one; the options are those of `ingest.flatten`."""

    def reason(message):
        params = message["params"]
        of_class = F.map_filter(params, lambda key, _: F.get(F.split(key, "/"), F.lit(7)).eqNullSafe(meter_class))
        why = (
            F.when(params.isNull(), F.when(is_object(text), "no_numeric_params").otherwise("not_an_object"))
            .when(F.size(params) == 0, "empty_params")
            .when(F.size(of_class) == 0, "no_energy_meter")
        )
        if drop_nan:
            numbers = F.map_filter(of_class, lambda _, value: ~F.coalesce(F.isnan(value), F.lit(False)))
            why = F.coalesce(why, F.when(F.size(numbers) == 0, "only_nan"))
        if not keep_malformed:
            why = F.coalesce(why, F.when(F.try_to_timestamp(message["ts"]).isNull(), "malformed_time"))
        return why

    return once(parsed(text, salvage), reason)
