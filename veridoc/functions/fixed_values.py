"""Word lists, letter tables and patterns that results depend on."""

# Stop-words, Arabic then English.
STOPWORDS = """
في من على الى إلى عن ان أن إن ما لا لم لن هل هو هي هم هن انا أنا انت نحن هذا هذه ذلك تلك
التي الذي الذين اللاتي او أو ثم قد كان كانت يكون تكون كل بعض عند مع اي أي و ف ب ل ك
اذا إذا اذ لو لكن بل حتى منذ قبل بعد غير بين حيث كما مثل عليه عليها عليهم فيه فيها فيهم
به بها بهم له لها لهم منه منها منهم الي عنه عنها هنا هناك ذا يا ايضا أيضا وهو وهي وما ولا
بسبب لاجل كيف متي اين ماذا لماذا كم هذي وش ايش
the a an of to in on for is are be do does did i my me you it this that with and or at by from
""".split()

# Words too common in questions to search for.
QUERY_NOISE = """
حكم يجوز يجوز؟ جائز الشرع شرعا شرعي الشرعي الاسلام الإسلام سماحه سماحة الشيخ شيخ السؤال الجواب
سؤال جواب افيدونا أفيدونا جزاكم الله خيرا ارجو أرجو اريد أريد ابغى ابي ممكن لي علي وش ايش
what is the ruling on islam islamic allowed permissible can i is it
""".split()

# Words of an answer that state no fact.
YES_NO = ("نعم", "yes", "no")

# Letters that attach to the next word, article prefixes and suffixes of the light stemmer.
CLITICS = "وفبل"
PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال")
SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ه", "ي")

# Honorific ligatures, foldings and digit tables.
LIGATURES = {"ﷺ": " صلى الله عليه وسلم ", "ﷻ": " جل جلاله ", "ﷲ": " الله "}
DIACRITICS = r"[ؐ-ًؚ-ٰٟۖ-ۭ]"
FOLD_FROM, FOLD_TO = "آأإٱىةؤئ", "اااايهوي"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"

# Patterns of personal data and secrets.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,4})?\b"
NUMBER_RUN = r"\+?\d(?:[\s.\-]?\d){6,22}"
MOBILE = r"^(?:966|00966)?0?5\d{8}$"
NATIONAL_ID = r"^[12]\d{9}$"

# Letters that tell languages of one script apart.
URDU, TURKISH, HAUSA = "[ٹڈڑںےۓھہۂ]", "[ğĞşŞıİ]", "[ɓɗƙƴƁƊƘƳ]"
LATIN_INTERFACES = ("tr", "id", "ms", "uz", "ha")

# Sentences of a transcript that are not the speaker's own words, the label that leads his, footnote marks.
DIALOGUE_QUESTION = r"^\s*(السؤال|سؤال|س|المقدم|السائل)\s*[:：]"
CITATION_ONLY = r"^\s*[\(\[].*[\)\]]\s*\.?\s*$"
BIBLIOGRAPHIC = r"^\s*[\(\[]?\s*(رواه|أخرجه|اخرجه|متفق عليه|نشرت?\s+في|من برنامج|مجموع فتاوى|انظر|سورة\s)"
ANSWER_LABEL = r"^\s*(الجواب|الشيخ|ج)\s*[:：]\s*"
FOOTNOTE = r"\s*\[\d+\]\s*"
