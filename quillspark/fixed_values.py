"""Word lists, endings and weights that results must agree on. Plain text, in their given order; nothing is computed here."""

#: Words that keyword profiles, query types and phrases leave out.
STOPWORDS = (
    "а", "без", "в", "во", "для", "где", "до", "его", "ее", "и", "или", "их", "к", "на", "над", "о", "об", "от", "по", "под", "при", "про",
    "как", "что", "кто", "какой", "какая", "какое", "какие", "когда", "почему", "чем", "сколько", "такое", "был", "была", "было", "были",
    "бывает", "бывают", "изучает", "изучают", "отвечает", "отвечают", "отличить", "расставлять", "ставится", "ставятся", "устроено",
    "с", "со", "у", "the", "and", "of",
)

#: Words that the terms of a query leave out.
QUERY_STOPWORDS = (
    "а", "без", "в", "во", "для", "до", "его", "ее", "её", "и", "или", "их", "к", "на", "над", "о", "об", "от", "по", "под", "при", "про",
    "как", "что", "кто", "какой", "какая", "какое", "какие", "каков", "какова", "каково", "каковы", "такие", "чего", "когда", "почему",
    "где", "чем", "сколько", "такое", "был", "была", "было", "были", "бывает", "бывают", "имел", "имела", "имело", "имели", "изучает",
    "изучают", "отвечает", "отвечают", "отличить", "расставлять", "ставится", "ставятся", "устроено", "с", "со", "у", "and", "of", "the",
)

#: Endings in the order in which they are tried; the first that fits is cut.
SUFFIXES = (
    "иями", "ями", "ами", "ого", "ему", "ыми", "ими", "ая", "яя", "ое", "ее", "ые", "ие", "ый", "ий", "ой", "ах", "ях", "ам", "ям",
    "ом", "ем", "ов", "ев", "ия", "ии", "ей", "ы", "и", "а", "я", "е", "о", "у", "ю",
)

#: Kinds of documents and the words that suggest them, in the order of the checks.
DOCUMENT_KINDS = {
    "workbook": ("рабочая тетрадь", "workbook", "тетрадь"),
    "textbook": ("учебник", "textbook", "uchebnik"),
    "manual": ("пособие", "руководство", "manual", "методич"),
    "collection": ("сборник", "задачник", "хрестоматия", "collection", "sbornik"),
}

#: Transliterated subjects after which a bare number is a grade.
GRADED_SUBJECTS = ("russkij jazyk", "jazyk", "geografija", "khimiya", "istorija", "biologija", "fizika", "literatura")

EXERCISE_TERMS = (
    "упражнение", "упражнения", "задание", "задания", "задачи", "тренировка", "тренировочные", "практика", "спишите", "выполните",
    "выполнить", "найдите", "подберите", "подчеркните",
)
PROBLEM_TERMS = ("решить", "реши", "решите", "вычислить", "вычислите", "найти", "найдите", "доказать", "докажите")
RULE_TERMS = ("правило", "правила", "правописание", "орфография", "пишется", "употребляется", "склонение", "спряжение")
EXPLANATION_TERMS = ("почему", "как", "объясни", "объяснить", "объясните", "расскажи", "рассказать")

#: Stems by which a query asks for a goal, a cause or a consequence; one with a hyphen is sought anywhere.
FOCUS_STEMS = {
    "goal": ("цел", "задач", "предназнач", "направлен", "преслед", "добива", "стрем"),
    "cause": ("причин", "почему", "обуслов", "вследств", "из-за"),
    "consequence": ("последств", "результат", "итог", "привел", "привёл"),
}

#: Stems by which a text announces a goal, a cause or a consequence.
CUE_STEMS = {
    "goal": ("цел", "задач", "предназнач", "направлен", "стрем", "добива"),
    "cause": (
        "причин", "предпосыл", "кризис", "недоволь", "оппозиц", "осложн", "поражен", "нежелан", "обуслов", "вследств", "потому",
        "поскольку", "благодар", "действи", "объясня",
    ),
    "consequence": ("последств", "результат", "итог", "привел", "стал", "вызва", "измен", "потер", "утрат", "усил", "ослаб"),
}
#: After one of these a crisis is what was caused.
REVERSED_CAUSE = ("вызва", "привел", "пород", "результ")

#: Words that open a question and name nothing.
QUESTION_OPENERS = (
    "в", "для", "где", "от", "как", "какая", "какие", "каким", "какими", "какой", "какую", "каков", "какова", "каково", "каковы",
    "когда", "кто", "почему", "расскажи", "назови", "объясни", "опиши", "перечисли", "покажи", "приведи", "сравни", "сравните",
    "сформулируй", "что", "чем",
)

EXERCISE_COMMANDS = (
    "выполните", "выполнить", "спишите", "найдите", "подчеркните", "составьте", "объясните", "ответьте", "прочитайте", "укажите",
    "запишите", "подберите", "определите", "сравните", "докажите", "разберите", "решите", "подготовьте",
)
TEST_MARKERS = (
    "верно определены", "верно определена", "неправильно определены", "неправильно определена", "укажите", "выберите", "какой вариант",
    "какие варианты",
)
NAVIGATION_MARKERS = ("приложение", "содержание", "оглавление", "словарь", "указатель", "страница", "страницы")
SCHEMA_MARKERS = (
    "план", "порядок", "схема", "алгоритм", "шаг", "этап", "разбор", "часть речи", "морфологические признаки", "синтаксическая роль",
    "грамматическая основа", "члены предложения", "формула", "последовательность",
)
RULE_MARKERS = ("правило", "следует", "пишется", "употребляется", "необходимо", "нужно", "надо")
DEFINITION_MARKERS = (
    "это", "называется", "называют", "является", "включает", "состоит", "характеризуется", "представляет собой", "определение", "означает",
)
EXPOSITION_MARKERS = (
    "является", "являются", "называется", "называют", "образуется", "образуются", "происходит", "происходят", "используется",
    "используются", "характерны", "так как", "потому что", "в результате", "например", "производство", "производства", "размещают",
    "влияет", "выбрасывает", "составляет", "занимает", "увеличивает",
)
INSTRUCTION_MARKERS = (
    "определить", "подчеркнуть", "указать", "выделить", "объяснить", "разобрать", "построить", "назвать", "выяснить", "получить",
    "получите", "добавить", "добавьте", "наблюдать", "наблюдайте", "записать", "запишите",
)
STRUCTURED_STEP_MARKERS = ("признаки", "порядок", "план", "формула", "роль")
EXAMPLE_MARKERS = ("например", "пример", "образец")

#: Spellings of a year's unit that stand for each other.
YEAR_WORDS = ("г", "год", "года", "году", "годы")

#: What a word of a query may also be told by.
TOPICAL_EXPANSIONS = {
    "правление": ("царствование", "реформы", "внутренняя политика", "внешняя политика", "война", "конгресс", "крепостное право"),
    "царствование": ("правление", "реформы", "внутренняя политика", "внешняя политика", "война", "конгресс", "крепостное право"),
}

SUBJECTS = (
    "history", "russian_language", "safety", "biology", "math", "literature", "geography", "physics", "chemistry", "social_studies", "unknown",
)
SUBJECT_ALIASES = {
    "russian": "russian_language",
    "русский": "russian_language",
    "русский язык": "russian_language",
    "обж": "safety",
    "civil_defense": "safety",
    "история": "history",
    "математика": "math",
    "биология": "biology",
}

#: What a query that asks for a goal, a cause or a consequence is also worded with.
FOCUS_EXPANSIONS = {
    "goal": ("цели", "задачи", "намерения", "стремились", "направлены"),
    "cause": ("предпосылки", "кризис", "недовольство", "оппозиция", "обусловлено"),
    "consequence": ("итоги", "изменения", "привело", "вызвало", "потери", "ухудшение", "ослабление"),
}
#: The same for causes outside of history.
PLAIN_CAUSE_EXPANSIONS = ("причина", "объясняется", "связано", "обусловлено")
