"""Word lists and number words."""

# The word lists and tables that results depend on.

STOP_WORDS = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по
только ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если
или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может
они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже
себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один
почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об
другой хоть после над больше тот через эти нас про всего них какая много разве три
эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более
всегда конечно всю между это также свой является которые который которая которых
кроме таким образом однако поэтому именно
""".split()

PARAPHRASES = """
составляет составляют составит составляла составлял установлен установлена установлено
установлены установленный установленном устанавливает устанавливают устанавливающий
размер размере размера размером равен равна равно равны согласно период срок значение
показатель
""".split()

BOILERPLATE = """
данный данная данные данном данного обеспечивает обеспечивают обеспечить позволяет
позволяют позволить оптимизация оптимизировать оптимизирует эффективность эффективный
эффективно эффективное реализация реализовать реализуется механизм механизмы подход
подходы аспект аспекты критерий критерии параметр параметры процесс процессы модуль
модули алгоритм алгоритмы метод методы метода методов решение решения решений задача
задачи задач результат результаты результатов использование использует используется
применение применяется применяются повышение повысить повышает существенно значительный
значительная комплексный комплексная комплексное ключевой ключевая ключевые устойчивый
устойчивая устойчивое современный современная современные вышеуказанный вышеперечисленный
необходимо отметить следует важно указанный приведённый представленный
""".split()

CLICHES = """
важно отметить|следует отметить|необходимо отметить|стоит отметить|стоит подчеркнуть|
необходимо подчеркнуть|таким образом|кроме того|более того|в рамках данного подхода|
в рамках предложенного подхода|на основе проведённого анализа|в современном мире|
в современных условиях|особое внимание следует уделить|представляет собой|
позволяет достичь|позволяет оптимизировать|обеспечивает повышение|
обеспечивает эффективное решение|ключевой аспект|ключевым фактором|комплексное решение|
поставленной задачи|поставленных целей|высокое качество|устойчивое функционирование|
существенное значение имеет|данный метод|данная модель|предложенный подход|
предложенный метод|предложенный механизм|рассматриваемый механизм|указанный алгоритм|
данное решение|в целом|в частности|в заключение|прежде всего|эффективное решение|
оптимальное решение|высоких показателей качества|существенно улучшить|
комплексной оптимизации параметров
""".replace("\n", "").split("|")

#: Words that stand for one number by themselves.
NUMBER_WORDS = {
    "ноль": 0, "один": 1, "одна": 1, "два": 2, "две": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7,
    "восемь": 8, "девять": 9, "десять": 10, "одиннадцать": 11, "двенадцать": 12, "пятнадцать": 15, "двадцать": 20,
    "тридцать": 30, "сорок": 40, "пятьдесят": 50, "сто": 100,
}

#: Words that runs of number words are made of.
NUMBER_PARTS = {
    "ноль": 0, "один": 1, "одна": 1, "одно": 1, "одного": 1, "одной": 1, "одному": 1, "два": 2, "две": 2, "двух": 2,
    "двумя": 2, "три": 3, "трёх": 3, "тремя": 3, "четыре": 4, "четырёх": 4, "пять": 5, "пяти": 5, "шесть": 6, "шести": 6,
    "семь": 7, "семи": 7, "восемь": 8, "восьми": 8, "девять": 9, "девяти": 9, "десять": 10, "десяти": 10,
    "одиннадцать": 11, "двенадцать": 12, "тринадцать": 13, "четырнадцать": 14, "пятнадцать": 15, "шестнадцать": 16,
    "семнадцать": 17, "восемнадцать": 18, "девятнадцать": 19, "двадцать": 20, "тридцать": 30, "сорок": 40,
    "пятьдесят": 50, "шестьдесят": 60, "семьдесят": 70, "восемьдесят": 80, "девяносто": 90, "сто": 100, "двести": 200,
    "триста": 300, "четыреста": 400, "пятьсот": 500, "тысяча": 1000, "тысячи": 1000, "тысяч": 1000,
}

#: Beginnings (four letters) of words whose following number names a document.
DOCUMENT_STEMS = "регл прик пост расп зако указ инст пись коде номе форм блан пасп прот доку №".split()

SUBJECT_SKIP = """
и а но или не в во на с со по для от до из о об при за к ко у это был была было быть
составляет составляют составляла составлял равен равна равно равняться установлен
установлена установлено установлены определен определена определено должен должна должно
может могут согласно то же также более менее только уже всего
""".split()

UNITS = {
    "года": "год", "годов": "год", "году": "год", "годом": "год", "годе": "год", "лет": "год", "гг": "год", "г.": "год",
    "месяца": "месяц", "месяцев": "месяц", "месяцу": "месяц", "месяцем": "месяц", "месяце": "месяц", "мес": "месяц",
    "недели": "неделя", "неделю": "неделя", "недель": "неделя", "неделя": "неделя", "дней": "день", "дня": "день",
    "дню": "день", "днём": "день", "дне": "день", "суток": "сутки", "часов": "час", "часа": "час", "часу": "час",
    "часом": "час", "часе": "час", "минут": "минута", "минуты": "минута", "минуту": "минута", "процента": "процент",
    "процентов": "процент", "проценту": "процент", "процентом": "процент", "%": "процент", "рублей": "рубль",
    "рубля": "рубль", "рубле": "рубль", "рублю": "рубль", "руб.": "рубль", "тысяч": "тысяча", "тысячи": "тысяча",
    "тыс.": "тысяча", "экземпляра": "экземпляр", "экземпляров": "экземпляр", "экземпляре": "экземпляр", "экземпляр": "экземпляр",
}

#: Endings that the stemmer takes off, tried in this order.
ENDINGS = """
иями ями ами иях ях ах ов ев ой ый ий ая яя ое ее ые ие ых их ем ом ым им ам ям ую юю ью ия ии ей
а я о е ы и у ю ь й
""".split()

SEARCH_STOP_WORDS = """
и в во не что он на я быть с а это все она так его но да ты к у же вы за мы из по о от до для или
если уже был была было были бы как то только их её тем также при
""".split()

TITLE_STOP_WORDS = "которым которые которого разрешается утверждении изменений внесении отдельные".split()

#: What makes a number near it unclear.
HEDGES = """
около|примерно|приблизительно|не менее|не более|и т.д|и тому подоб|некоторые|несколько|как правило|
возможно|в зависимости|соответствующ|установленн|ряд случаев|многие|либо|или более|от 
""".strip("\n").replace("\n", "").split("|")

#: Words that end in a full stop without ending a sentence.
ABBREVIATIONS = "т е д п г гг рис табл см др проф акад тыс млн млрд руб коп с стр напр им обл р ул кв оф mr dr etc vs i.e e.g".split()

#: Kinds of values and their patterns, from special to general.
_UNIT = "лет|года|годов|году|год|месяцев|месяца|месяц|мес|недель|недели|неделю|дней|дня|день|суток|часов|часа|час|минут|минуты|минуту"
_NUMBER = (
    "одного|одной|одному|один|одна|двух|двумя|два|две|трёх|тремя|три|четырёх|четыре|пяти|пять|"
    "шести|шесть|семи|семь|восьми|восемь|девяти|девять|десяти|десять|одиннадцать|двенадцать|"
    "тринадцать|четырнадцать|пятнадцать|шестнадцать|семнадцать|восемнадцать|девятнадцать|"
    "двадцать|тридцать|сорок|пятьдесят|шестьдесят|семьдесят|восемьдесят|девяносто|сто"
)
_MEASURE = (
    "экземпляров|экземпляра|экземпляр|процентов|процента|процент|рублей|рубля|рубль|"
    "документов|документа|человек|сотрудников|сотрудника|дней|дня|день|раз|раза|штук|штуки"
)
_MONTH = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря"
VALUE_PATTERNS = {
    "date_day_month_year": rf"\d{{1,2}}\s+(?:{_MONTH})\s+\d{{4}}(?:\s*г(?:ода)?\.?)?",
    "date_numeric": r"\d{1,2}\.\d{1,2}\.\d{2,4}",
    "year": r"\d{4}\s*(?:год|года|году|г\.)",
    "money": r"\d[\d\s]*(?:,\d+)?\s*(?:руб(?:лей|ля|\.)?|тыс\.?\s*руб(?:\.|лей)?)",
    "percent": r"\d+(?:[,.]\d+)?\s*(?:процент(?:ов|а)?|%)",
    "word_term": rf"(?:{_NUMBER})\s+(?:{_UNIT})",
    "digit_term": rf"\d[\d\s]*\s*(?:{_UNIT})",
    "digit_measure": rf"\d[\d\s]*(?:,\d+)?\s+(?:{_MEASURE})",
    "count": r"\d[\d\s]{0,12}\d",
    "single_number": r"\d",
    "text_after_verb": r"(?:составляет|составляют|равен|равно|равна|равны|установлен|устанавливается|определяется|принимает)\s+(?:[А-Яа-яЁё]+(?:\s+[А-Яа-яЁё]+){0,2})",
}

#: What starts a condition.
CONDITIONS = (
    "если|в случае|при условии|за исключением|кроме случаев|кроме|по согласованию|в порядке|установленном|при этом|"
    "в течение|не позднее|не ранее|за исключением случаев"
).split("|")

#: Words that are no subject of a value.
NO_SUBJECT = """
и а но или в во на за по от до из с со к у о об при для не ни что как этом этой этот эти этих том
его ее их быть был была были составляет составляют является являются должен должна должно должны
может могут имеет имеют устанавливается устанавливают определяется также числе
""".split()

#: Signs (as in a character class) and words that part clauses.
CLAUSE_SIGNS = r',;:()\[\]{}«»"“”'
CLAUSE_WORDS = (
    r"и|а|но|или|либо|причем|причём|при\s+этом|который|которая|которое|которые|"
    r"что|чтобы|если|когда|в\s+случае|за\s+исключением|кроме|порядке|соответствии"
)

#: Control words of RTF: groups that hold no text of the document, words that break a line, words that are a blank.
RTF_SERVICE = """
fonttbl colortbl stylesheet info pict object header footer footnote fldinst xmlnstbl listtable
listoverridetable rsidtbl generator themedata colorschememapping latentstyles datastore filetbl revtbl xfld
""".split()
RTF_BREAKS = "par line pard sect page".split()
RTF_BLANKS = "tab cell row nestcell nestrow".split()

#: Words of a citation (each before its number), units of numbers, and words that say nothing near them.
CITATION_WORDS = r"стать[яиейю]|ст\.|пункт[а-я]*|п\.|част[ьию]|ч\.|подпункт[а-я]*|пп\.|глав[аы]|раздел[а-я]*|абзац[а-я]*"
ATOM_UNITS = (
    r"процент[а-я]*|%|рубл[а-я]*|руб\.?|копе[йяк]+|тыс\.?|млн|млрд|дн[ейя]+|месяц[ев]*|"
    r"лет|год[ау]?|час[ов]*|минут[ы]*|секунд[ы]*|раз|крат|шт\.?|человек|единиц[ы]*"
)
ATOM_STOP_WORDS = """
для лицо которое который которые которых данном данного данный настоящего настоящем также может быть были
было есть при этом случае порядке соответствии статья статьей пункт часть федерального закона российского
российской Федерации
""".split()

#: Features of a candidate span, in the order of a filter's head.
SPAN_FEATURES = """
scored_count seed_count max_risk mean_risk min_risk risk_mass low_fraction high_fraction char_width token_width
bridged_gaps bridged_tokens left_gradient right_gradient exact_anchor rule_tag relative_start relative_end
p1_calibrated_score
""".split()

#: Phrases by which the share of machine text is judged.
MACHINE_CLICHES = (
    "данный|осуществляется|необходимо отметить|комплексное решение|эффективное решение|в рамках|в целях|обеспечивает|"
    "позволяет достичь|высоких показателей|представляет собой|является|следует отметить|в соответствии с"
).split("|")

#: Characters that a text may have.
MOST_CHARS = 2_000_000

MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()

#: Weights of the five working features in a token's risk.
WEIGHTS = {"entropy": 0.1, "mass": 0.4, "mass_norm": 0.2, "max_sim": 0.2, "density": 0.1}
DENSITY_REFERENCE = 0.52
LABEL_RISK, TOP_SHARE, SUBJECT_WINDOW, MATCH_MIN = 0.75, 0.2, 6, 0.5
THRESHOLD, SPAN_Z, SPAN_FLOOR, SPAN_CAP = 0.5, 1.0, 0.35, 0.6
#: The frozen verdict rule: mask tokens and characters of the longest span that make an answer doubtful.
MIN_MASK_TOKENS, MIN_FRAGMENT_CHARS = 2, 20
#: Punctuation that is not part of a word.
EDGES = ".,;:!?()«»\"'—–-"
BM25_K1, BM25_B = 1.5, 0.75
CHUNK_TOKENS, CHARS_PER_TOKEN, CHUNK_OVERLAP = 380, 2.7, 1
# End of fixed values.
