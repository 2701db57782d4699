"""Word lists, letters and names that results depend on."""

# Function words that tell Romanian and English apart; AMBIGUOUS ones are in neither.
ROMANIAN = """
și si este sunt pentru la de cu nu să sa că ca în pe din dacă daca avem fost acolo aici cum noi ce se dar
foarte trebuie au lui acest această aceasta deja unde când cand tot așa asa sau după dupa până pana între
intre fără fara doar acum atunci încă inca fiecare toate toți toti nimic ceva altceva pacient pacientul
pacienta pacientii pacienții secția sectia spital spitalul domnul doamna medicul doctorul suntem aveți aveti
puteți puteti facem făcut facut vom vor mă ma vă va îl il le lor lui ei ele este era erau fie fiind decât decat
adică adica bine da ca să
""".split()
ENGLISH = """
the and is are to of for with that this we you it in on not have has be was were do does what how about from
will can should our they there if so but at by an or as all he she his her would could then them their been
than into which when where who why because also just very more most some any each other patient patients
hospital doctor please okay
""".split()
AMBIGUOUS = {"a", "am", "care", "mai", "o", "un", "no", "me", "i"}

# Negations by language.
NEGATIONS = {
    "ro": ["nu", "n-a", "n-au", "n-am", "n-ai", "n-ati", "n-ar", "nici", "fara", "fără", "deloc", "nicidecum"],
    "ru": ["не", "нет", "ни", "никогда", "никто", "ничего", "без", "никак"],
    "en": ["no", "not", "none", "neither", "never", "without", "hardly", "barely", "didn't", "doesn't", "wasn't", "won't", "can't"],
}

# Lower-case Cyrillic letters and their Latin spelling.
TRANSLITERATION = [
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ё", "yo"), ("ж", "zh"), ("з", "z"), ("и", "i"), ("й", "y"),
    ("к", "k"), ("л", "l"), ("м", "m"), ("н", "n"), ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"), ("у", "u"), ("ф", "f"),
    ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ъ", ""), ("ы", "y"), ("ь", ""), ("э", "e"), ("ю", "yu"), ("я", "ya"),
]
LATIN_DIGRAPHS = [("shch", "щ"), ("yo", "ё"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"), ("yu", "ю"), ("ya", "я")]
LATIN_LETTERS = list(zip("abvgdeziyklmnoprstuf", "абвгдезийклмнопрстуф"))
SURNAME_ENDINGS = ["ov", "ova", "ev", "eva", "in", "ina", "sky", "skiy", "skaya", "ich"]
HONORIFICS = r"(?iU)^(?:dr\.?|prof\.?|dna\.?|dl\.?|doctor|medic|asistent|conf\.?|academician)\s+"

# Words that are no keywords of a title or an agenda.
KEYWORD_STOPWORDS = """
si și in în la de cu din pe pentru o un unui unei despre comitet sedinta ședință raport proces verbal director medical al ale ai sau
dar iar sub spre catre către peste prin fara fără contra intre între
и в на с по о об для от до из к за собрание заседание отчет протокол или но как так все это при после перед под над между
and on with for of to the a an meeting report minutes by at from into about over after is are was were be been being have has had
""".split()

# Names of the days, by Spark's day code.
DAYS = [
    ("MON", ["luni", "понедельник", "понедельника", "monday"]),
    ("TUE", ["marți", "marti", "вторник", "вторника", "tuesday"]),
    ("WED", ["miercuri", "среда", "среды", "wednesday"]),
    ("THU", ["joi", "четверг", "четверга", "thursday"]),
    ("FRI", ["vineri", "пятница", "пятницы", "friday"]),
    ("SAT", ["sâmbătă", "sambata", "суббота", "субботы", "saturday"]),
    ("SUN", ["duminică", "duminica", "воскресенье", "воскресенья", "sunday"]),
]

# What an anonymous speaker is called.
SUMMARY_LANGUAGES = {"ro": "Vorbitorul", "en": "Speaker", "ru": "Участник"}

# What is said when something is decided, given to somebody, or open.
DECISION_PHRASES = [
    "s-a decis", "am decis", "s-a hotărât", "aprobăm", "aprobat", "de acord", "am căzut de acord",
    "решили", "согласовали", "принимаем решение", "утверждаем", "договорились",
    "we decided", "agreed", "approved", "consensus reached", "it is decided",
]
ACTION_PHRASES = [
    "trebuie să", "va pregăti", "voi pregăti", "va actualiza", "voi actualiza", "va transmite", "voi transmite", "responsabil", "să se ocupe",
    "va verifica", "voi verifica", "va trimite", "voi trimite",
    "нужно сделать", "подготовить", "я подготовлю", "я обновлю", "отвечает", "проверит", "отправит", "срочно передать", "сделаю",
    "action item", "will finalize", "will handle", "i will update", "i will prepare", "responsible for", "deadline is", "must prepare",
]
RISK_PHRASES = ["risc", "опасность", "не решено"]
