"""Parameter strings "key value key value ...", parsed by a known list of keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known keys, those that describe the service, and those left out of search texts.
KEYS = [
    "Место оказания услуг", "Тип услуги автосервиса", "Тип услуги", "Тип стоимости за услугу", "Тип стоимости", "Гарантия", "Опыт работы",
    "Где вы оказываете услуги", "Название услуги", "Специальность или сфера", "Время для связи, дни недели", "Время для связи от", "Время для связи до",
    "График работы от", "График работы до", "Время работы, с", "Время работы, до", "Онлайн-запись", "Ваши клиенты", "Кто оказывает услуги", "Дополнительно",
    "Начальная цена", "Стоимость", "Вид услуги", "Продолжительность", "Куда выезжаете", "Районы", "Работа по договору", "Признак предзаполнения прайс листа",
    "Инструменты", "Минимальное время заказа", "Рейтинг пользователя",
    "Предмет или специальность", "Срочная услуга (мультистатус)", "Поиск по слотам", "Преподаватель", "Рабочие дни",
]
SERVICE_KEYS = ["Вид услуги", "Тип услуги", "Тип услуги автосервиса", "Название услуги", "Специальность или сфера", "Услуга", "Дополнительно"]
DROP_KEYS = [
    "Место оказания услуг", "Время для связи, дни недели", "Время для связи от", "Время для связи до", "График работы от", "График работы до",
    "Время работы, с", "Время работы, до", "Стоимость", "Опыт работы", "Районы", "Признак предзаполнения прайс листа", "Минимальное время заказа",
    "Тип стоимости за услугу", "Тип стоимости", "Начальная цена", "Продолжительность",
]


def pattern(keys: list[str]) -> str:
    """A key at the start or after a space, before a space or the end; longer keys are tried first."""
    by_length = sorted((re.escape(k).replace("\\ ", " ").replace("\\-", "-") for k in keys), key=len, reverse=True)
    return "(?:^| )(" + "|".join(by_length) + ")(?= |$)"


def parse(s: Column, keys: list[str] = KEYS) -> Column:
    """array<struct<key, value>> in order: a value is the trimmed text up to the next key; text before the first key goes."""
    found = F.regexp_extract_all(s, F.lit(pattern(keys)), F.lit(1))
    values = F.transform(F.slice(F.split(s, pattern(keys)), F.lit(2), F.size(found)), lambda v: F.trim(v))
    return F.zip_with(found, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))


def values_of(parsed: Column, key: str) -> Column:
    return F.transform(F.filter(parsed, lambda p: p["key"] == key), lambda p: p["value"])


def as_map(parsed: Column) -> Column:
    """map<key, array<value>>, repeated keys gathered in order."""
    keys = F.array_distinct(F.transform(parsed, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(parsed, lambda p: p["key"] == k), lambda p: p["value"])))


def service_text(parsed: Column) -> Column:
    keep = F.filter(parsed, lambda p: p["key"].isin(SERVICE_KEYS) & (p["value"] != ""))
    return F.array_join(F.transform(keep, lambda p: p["value"]), " ")


def clean_text(parsed: Column) -> Column:
    keep = F.filter(parsed, lambda p: ~p["key"].isin(DROP_KEYS) & (p["value"] != ""))
    return F.array_join(F.transform(keep, lambda p: p["value"]), " ")


def vid_match(search: Column, item: Column) -> Column:
    """1 or 0 whether the first value agrees; -1 without that filter."""
    key = "Вид услуги"
    want = F.coalesce(F.get(values_of(search, key), F.lit(0)), F.lit(""))
    return F.when(want == "", -1).otherwise((F.coalesce(F.get(values_of(item, key), F.lit(0)), F.lit("")) == want).cast("int"))


def tip_match(search: Column, item: Column) -> Column:
    key = "Тип услуги"
    want = F.coalesce(F.get(values_of(search, key), F.lit(0)), F.lit(""))
    return F.when(want == "", -1).otherwise(F.array_contains(values_of(item, key), want).cast("int"))


def other_match(search: Column, item: Column) -> Column:
    """Mean over the other filters of whether the item has the key and, if one is given, the value; -1 without such filters."""
    asked = F.filter(search, lambda p: ~p["key"].isin("Вид услуги", "Тип услуги", "Рейтинг пользователя"))
    hit = F.transform(asked, lambda p: F.exists(item, lambda i: (i["key"] == p["key"]) & ((p["value"] == "") | (i["value"] == p["value"]))).cast("double"))
    return F.when(F.size(asked) == 0, F.lit(-1.0)).otherwise(F.aggregate(hit, F.lit(0.0), lambda a, x: a + x) / F.size(asked))
