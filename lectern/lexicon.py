"""Word lists and patterns of the domain lexicon; operators take any other as a parameter."""

from __future__ import annotations

# They must equal the published behaviour for right results.
STOP_WORDS = (
    "the a an is are was were be been being in on at to for of with by from and or but not what which who how does do did can would should could "
    "this that these those it its we our they them their his her has have had all each every both few more most some any such there here when where "
    "why if then than so no yes about"
).split()

# Intents in the order in which they are tried.
INTENTS = {
    "exegesis": r"(?:explain|what does|meaning of|interpret|study|analysis|deep dive)",
    "comparison": r"(?:compare|versus|vs\.?|difference between|similarities|unlike|while\s+\w+|but\s+\w+)",
    "devotional": r"(?:how|why|what can we|personal|application|practical|spiritual growth|encourage)",
    "theological": r"(?:doctrine|theology|belief|doctrinal|systematic|nature of|attribute of|God's nature)",
    "cross-reference": r"(?:cross.?ref|other place|where else|parallel|same theme|similar passage|related)",
}
FALLBACK_INTENT = ("theological", r"(?:God|Jesus|Christ|Holy Spirit|law|grace|faith|covenant|kingdom|sin)")

# Themes and the substrings that show them.
THEMES = {
    "creation": "create creation created beginning form make maker".split(),
    "covenant": "covenant promise oath sign everlasting perpetual".split(),
    "redemption": "redeem deliver save salvation ransom rescue".split(),
    "judgment": "judge judgment condemn punish wrath justice".split(),
    "mercy": "mercy grace compassion forgive forgiveness pity".split(),
    "faith": "faith believe trust belief faithful faithfulness".split(),
    "worship": "worship praise adoration holy glory worshipped".split(),
    "law": "law commandment statute ordinance torah decree".split(),
    "kingdom": "kingdom king reign sovereign throne rule".split(),
    "spirit": "spirit soul breath heart inner spiritual".split(),
    "love": "love loved charity dear beloved".split(),
    "wisdom": "wisdom wise understanding knowledge discern".split(),
    "prophecy": "prophesy prophecy vision reveal revelation seer".split(),
    "resurrection": "rise raised resurrect life death alive living".split(),
}

# Words that raise the usability score.
ACADEMIC_TERMS = "therefore because thus consequently nevertheless justified sanctification righteousness grace exegesis hermeneutic theology doctrinal biblical".split()

# Book codes and English names, in canonical order.
BOOKS = {
    "GEN": "Genesis", "EXO": "Exodus", "LEV": "Leviticus", "NUM": "Numbers", "DEU": "Deuteronomy", "JOS": "Joshua", "JDG": "Judges", "RUT": "Ruth",
    "1SA": "1 Samuel", "2SA": "2 Samuel", "1KI": "1 Kings", "2KI": "2 Kings", "1CH": "1 Chronicles", "2CH": "2 Chronicles", "EZR": "Ezra", "NEH": "Nehemiah", "EST": "Esther",
    "JOB": "Job", "PSA": "Psalms", "PRO": "Proverbs", "ECC": "Ecclesiastes", "SOL": "Song of Solomon", "ISA": "Isaiah", "JER": "Jeremiah", "LAM": "Lamentations", "EZE": "Ezekiel", "DAN": "Daniel",
    "HOS": "Hosea", "JOEL": "Joel", "AMOS": "Amos", "OBA": "Obadiah", "JON": "Jonah", "MIC": "Micah", "NAM": "Nahum", "HAB": "Habakkuk", "ZEP": "Zephaniah", "HAG": "Haggai", "ZEC": "Zechariah", "MAL": "Malachi",
    "MAT": "Matthew", "MRK": "Mark", "LUK": "Luke", "JHN": "John", "ACT": "Acts", "ROM": "Romans", "1CO": "1 Corinthians", "2CO": "2 Corinthians", "GAL": "Galatians", "EPH": "Ephesians", "PHP": "Philippians", "COL": "Colossians",
    "1TH": "1 Thessalonians", "2TH": "2 Thessalonians", "1TI": "1 Timothy", "2TI": "2 Timothy", "TIT": "Titus", "PHM": "Philemon", "HEB": "Hebrews", "JAS": "James",
    "1PE": "1 Peter", "2PE": "2 Peter", "1JN": "1 John", "2JN": "2 John", "3JN": "3 John", "JUD": "Jude", "REV": "Revelation",
}
# English spellings beyond the full name and the code; numbered books also go by their code with a blank ("1 sa").
ENGLISH = {
    "JDG": ["jdge"], "PSA": ["psalm"], "PRO": ["prov"], "MAT": ["matt", "mt"], "MRK": ["mk", "mar"], "LUK": ["lk"], "JHN": ["jn"], "ROM": ["ro"], "1CO": ["1 cor"], "2CO": ["2 cor"],
    "PHP": ["phil", "phl"], "1TH": ["1 thess", "1the"], "2TH": ["2 thess", "2the"], "1TI": ["1 tim"], "2TI": ["2 tim"],
}
#: Codes that are no spelling of their book.
NOT_SPELLED = {"JDG"}
# Korean spellings of each book.
KOREAN = {
    "GEN": ["창세기", "창세"], "EXO": ["출애굽기", "출애", "출"], "LEV": ["레위기", "레"], "NUM": ["민수기", "민수", "민"], "DEU": ["신명기", "신명", "신"],
    "JOS": ["여호수아", "여호수"], "JDG": ["사사기", "사사"], "RUT": ["루트", "룻"], "1SA": ["사무엘상"], "2SA": ["사무엘하"], "1KI": ["열왕기상"], "2KI": ["열왕기하"], "1CH": ["역대상"], "2CH": ["역대하"],
    "EZR": ["에스라", "에스"], "NEH": ["느헤미야", "느헤"], "EST": ["에스더", "에스"],
    "JOB": ["욥기", "욥"], "PSA": ["시편", "시", "찬미"], "PRO": ["잠언", "잠", "지혜"], "ECC": ["전도서", "전도"], "SOL": ["아래의 노래", "찬가"],
    "ISA": ["이사야", "이사"], "JER": ["예레미야", "예레"], "LAM": ["애가", "애", "통곡"], "EZE": ["에제키엘", "에스겔"], "DAN": ["다니엘", "다니"],
    "HOS": ["호세아", "호"], "JOEL": ["요엘", "요"], "AMOS": ["아모스", "아"], "OBA": ["오바댜", "오바디아", "오"], "JON": ["요나", "욘"], "MIC": ["미가", "미"], "NAM": ["나훔", "나"],
    "HAB": ["하박국", "하바"], "ZEP": ["스바냐"], "HAG": ["학개"], "ZEC": ["스가랴"], "MAL": ["말라기", "말라"],
    "MAT": ["마태복음", "마태", "마타", "마"], "MRK": ["마르코복음", "마르코", "마가복음", "마가", "막", "막달"], "LUK": ["루카복음", "루카", "눋", "누가"], "JHN": ["요한복음", "요한", "요복", "요"],
    "ACT": ["사도행전", "사도", "사행"], "ROM": ["로마서", "로마", "롬"], "1CO": ["고린도전서", "고린도전", "고전"], "2CO": ["고린도후서", "고린도후", "고후"],
    "GAL": ["갈라티아", "갈", "갈서"], "EPH": ["에베소서", "에베", "엡"], "PHP": ["빌립보서", "빌립", "빌립보", "빌"], "COL": ["골로새서", "골라", "골"],
    "1TH": ["살례전서", "살례전", "살전"], "2TH": ["살례후서", "살례후", "살후"], "1TI": ["디모데전서", "디모데전", "전"], "2TI": ["디모데후서", "디모데후", "후"], "TIT": ["디도서", "디도"], "PHM": ["빌레몬서", "빌레몬"],
    "HEB": ["히브리서", "히브", "히브리"], "JAS": ["야고보서", "야고", "雅", "약"], "1PE": ["베드로전서", "베드로전", "전서"], "2PE": ["베드로후서", "베드로후", "후서"],
    "1JN": ["요한일서", "요한일", "일서"], "2JN": ["요한이서", "요한이"], "3JN": ["요한삼서", "요한삼"], "JUD": ["유다서", "유다"], "REV": ["요한의 묵시록", "묵시록", "계", "계시록"],
}
# Full Korean names, which count anywhere in a question and before a chapter.
KOREAN_FULL = {
    "창세기": "GEN", "출애굽기": "EXO", "레위기": "LEV", "민수기": "NUM", "신명기": "DEU", "여호수아": "JOS", "사사기": "JDG", "룻": "RUT", "사무엘상": "1SA", "사무엘하": "2SA", "열왕기상": "1KI", "열왕기하": "2KI",
    "역대상": "1CH", "역대하": "2CH", "에스라": "EZR", "느헤미야": "NEH", "에스더": "EST", "욥": "JOB", "시편": "PSA", "잠언": "PRO", "전도서": "ECC", "아가": "SOT", "이사야": "ISA", "예레미야": "JER", "예레미애": "LAM",
    "에스겔": "EZE", "다니엘": "DAN", "호세아": "HOS", "요엘": "JOEL", "아모스": "AMOS", "오바댜": "OBA", "요나": "JON", "미가": "MIC", "나훔": "NAM", "학개": "HAG", "스게론": "ZEC", "말라기": "MAL",
    "마태복음": "MAT", "마가복음": "MRK", "누가복음": "LUK", "요한복음": "JHN", "사도행전": "ACT", "로마서": "ROM", "고린도전서": "1CO", "고린도후서": "2CO", "갈라디아서": "GAL", "에베소서": "EPH", "빌립보서": "PHP", "골로새서": "COL",
    "데살로니가전서": "1TH", "데살로니가후서": "2TH", "디모데전서": "1TI", "디모데후서": "2TI", "디도서": "TIT", "빌레몬서": "PHM", "히브리서": "HEB", "야고보서": "JAS", "베드로전서": "1PE", "베드로후서": "2PE",
    "요한일서": "1JN", "요한이서": "2JN", "요한삼서": "3JN", "유다서": "JUD", "요한계시록": "REV", "묵시록": "REV",
}
# Korean names that may stand right before a chapter ("롬 8장").
KOREAN_CHAPTER = {
    "롬": "ROM", "창": "GEN", "출": "EXO", "레": "LEV", "민": "NUM", "신": "DEU", "여호수": "JOS", "사사": "JDG", "룻": "RUT", "사무엘상": "1SA", "사무엘하": "2SA", "열왕기상": "1KI", "열왕기하": "2KI", "역대상": "1CH", "역대하": "2CH",
    "에스라": "EZR", "느헤미": "NEH", "에스더": "EST", "욥": "JOB", "시": "PSA", "시편": "PSA", "잠": "PRO", "잠언": "PRO", "전": "ECC", "전도": "ECC", "이사": "ISA", "예레": "JER", "애": "LAM", "에스겔": "EZE", "다니": "DAN",
    "마태": "MAT", "마태복음": "MAT", "마": "MAT", "막": "MRK", "막달": "MRK", "루카": "LUK", "눋": "LUK", "요한복음": "JHN", "요한": "JHN", "요": "JHN", "사도행전": "ACT", "사도": "ACT", "고전": "1CO", "고후": "2CO", "갈": "GAL",
    "엡": "EPH", "빌": "PHP", "빌립": "PHP", "골": "COL", "살전": "1TH", "살후": "2TH", "전서": "1PE", "후서": "2TI", "디모데전": "1TI", "디모데후": "2TI", "디도": "TIT", "빌레몬": "PHM", "히브": "HEB", "히브리": "HEB", "야고": "JAS",
    "雅": "JAS", "약": "JAS", "베드로전": "1PE", "베드로후": "2PE", "요일": "1JN", "요이": "2JN", "요삼": "3JN", "유다": "JUD", "계": "REV", "계시록": "REV", "묵시": "REV",
}
# Names of numbered books, with the plural that may be left out, and the letters of their codes, in the order in which they are tried.
NUMBERED = {"peter": "PE", "timothy": "TI", "thessalonians?": "TH", "john": "JN", "chronicles?": "CH", "kings?": "KI", "samuel": "SA", "corinthians?": "CO"}
ORDINALS = {"1": ["1", "first", "i"], "2": ["2", "second", "ii"], "3": ["3", "third", "iii"]}
# The one Korean spelling of a numbered book that is long enough to count anywhere in a Korean question.
KOREAN_NUMBERED = {"데살로니가전서": "1TH"}
# The books whose number of chapters is known to the evidence rules, with that number.
CHAPTERS = {"MRK": 16, "JHN": 21, "ACT": 28, "ROM": 16, "1CO": 16, "2CO": 13, "2KI": 25, "2CH": 36}
#: Full English names; further spellings of a full name.
ALIASES = {"psalm": "PSA", "prov": "PRO"}
NAME_TO_BOOK = {name.lower(): code for code, name in BOOKS.items()} | ALIASES


def spellings(code: str) -> list[str]:
    """All spellings of a book: its full name, its code, others in English, Korean ones."""
    low = code.lower()
    numbered = [f"{low[0]} {low[1:]}"] if low[0].isdigit() else []
    return list(dict.fromkeys([BOOKS[code].lower(), *numbered, *([] if code in NOT_SPELLED else [low]), *ENGLISH.get(code, []), *KOREAN.get(code, [])]))


#: (spelling, book) in the order of the books; a spelling may stand for two books, and the first to claim a place has it.
SPELLINGS = [(name, code) for code in BOOKS for name in spellings(code)]
#: Each spelling's book where only one can be meant; the last one wins.
ALIAS_TO_BOOK = dict(SPELLINGS)
#: English spellings of numbered books that count anywhere in a question ("first kings", "ii kings", "1kings", "firstkings").
NUMBERED_NAMES = {
    form: f"{digit}{letters}"
    for name, letters in NUMBERED.items()
    for digit, (_, word, roman) in ORDINALS.items()
    if f"{digit}{letters}" in BOOKS
    for form in (f"{word} {name.rstrip('?')}", f"{roman} {name.rstrip('?')}", f"{digit}{name.rstrip('?')}", f"{word}{name.rstrip('?')}")
}
# Names that a passage (unlike a question) is not searched for.
NOT_IN_PASSAGES = {"HOS", "JOEL", "AMOS", "OBA", "JON", "MIC", "NAM", "HAB", "ZEP", "HAG", "ZEC", "MAL", "SOL", "PHM", "2JN"}
