"""Typed-in rows that queries run on beside the driver's tables, which hold no Russian and few numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEXTS = [
    "Срок хранения первичных документов составляет двадцать пять лет.",
    "Сто двадцать рублей и пять процентов; тысяча двести часов.",
    "Три тысячи пятьсот экземпляров, две тысячи рублей.",
    "24 июня 2025 г. подписан приказ № 7 от 1 мая 2024 года.",
    "Срок до 3.4.24, затем 03.11.2023 и 5.12.2025.",
    "Плата равна 10 % от 5 лет, 3 месяцев и 12 дней.",
    "Работникам выплачивается 20 руб.за день, т.е. около 600 рублей в месяц. Это всё.",
    "Документ (см. рис. 5) хранится пять лет. Иначе его уничтожают! Вот так.",
    "ООО «Ромашка» на ул. Ленина, 10 т. е. рядом. Далее идёт текст",
    "Хранение, хранения, хранением; документами и документов.",
    "no numbers here at all", "one 1 and 2,5 and 3.75!", "", "   ", "ноль один одного",
    "пять-десять лет и двадцать. Пять!", "в 2024 году ставка составила 7,5 процента",
    "Более того, данный метод обеспечивает повышение. Таким образом, это важно.",
]

#: Contexts and answers: faithful, a value of another subject, a changed value, an omission, a condition left out, an invention.
PAIRS = [
    ("p1", "Срок хранения первичных документов составляет пять лет. Срок хранения вторичных документов составляет десять лет.", "Срок хранения первичных документов составляет пять лет."),
    ("p2", "Срок хранения первичных документов составляет пять лет. Срок хранения вторичных документов составляет десять лет.", "Срок хранения первичных документов составляет десять лет."),
    ("p3", "Размер государственной пошлины составляет 350 рублей за каждый документ.", "Размер государственной пошлины составляет 500 рублей за каждый документ."),
    ("p4", "Срок рассмотрения заявления гражданина составляет 30 дней, если не требуется проверка сведений.", "Срок рассмотрения заявления гражданина составляет 30 дней."),
    ("p5", "Срок рассмотрения заявления гражданина составляет 30 дней с момента регистрации.", "Срок рассмотрения заявления гражданина исчисляется с момента регистрации."),
    ("p6", "Журнал учёта ведётся в отделе кадров и хранится 75 лет в архиве организации.", "Погода сегодня хорошая, а завтра будет дождь и сильный ветер с моря."),
    ("p7", "Ставка налога равна 13 процентов от суммы дохода работника.", "Ставка налога равна 13 процентов от суммы дохода работника, а также выплачивается премия 5000 рублей ежегодно."),
    ("p8", "", "Ответ без документа."), ("p9", "Документ без ответа составляет 5 листов бумаги формата А4.", ""),
]


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "pair_id string, context string, answer string")


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of the rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


TEXTS_SQL = values_sql("cases", "id, text", list(enumerate(TEXTS)))
PAIRS_SQL = values_sql("cases", "pair_id, context, answer", PAIRS)
