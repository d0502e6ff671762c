"""Word lists of the domain router and of the retrieval gates, and their normal form."""

from __future__ import annotations

import re
import unicodedata

from lodestone.functions import text as T

# The domains in their order, and the words that name them.
DOMAINS = ("al7an", "taqs", "tari5", "saints", "coptic", "bible", "ta3lim", "school")
TERMS = {
    "al7an": "hymn, tune, melody, لحن, الحان, مرد, ذكصولوجيه, تسبحه",
    "taqs": "طقس, قداس, افخارستيا, إفخارستيا, بخور, الصوم الكبير, صوم الرسل, اصوام, الاصوام, عيد, اعياد, اسرار, أسرار, كنسيات, شمامسه, شماس, شمامس, ابصالتس, ابسالتس, اغنسطس, دياكون, ذياكون, رتب الشمامسه, رفع بخور عشية و باكر, رفع بخور عشية وباكر, لبس التونية و المزامير, لبس التونية, تقديم الحمل, اختيار الحمل, طبق الحمل, قربان, قربانه, قربانات, قداس الموعوظين, صلاة الصلح, الأنافورا, انافورا, قدوس, تجسد و تأنس, التقديس, الأواشي و الطلبات, الاواشي والطلبات, المجمع و الترحيم, المجمع والترحيم, القسمة, سر المعمودية, سر الميرون, سر التوبة, سر الاعتراف, سر التوبة والاعتراف, سر الإفخارستيا, سر الافخارستيا, سر التناول, سر مسحة المرضى, سر القنديل, سر الزيجة, سر الإكليل, طقس الإكليل, صلاة الإكليل, حلول السر, سر الكهنوت, الإبروسفارين, ابروسفارين",
    "tari5": "تاريخ, عقيده, مجمع, مجامع, الايمان, كنيسه, لاهوت, البابا, بطرك, بطريرك, اثناسيوس, كيرلس, اريوسيه, اريوس, نسطور, عمود الدين, ابطال الايمان",
    "saints": "سنكسار, قديس, قديسه, شهيد, سيره",
    "coptic": "coptic, قبطي, قواعد, لغه قبطي, لغقة قبطية, حروف",
    "bible": "bible, cartoon, كارتون, genesis, verse, verses, كتاب, ايات, سفر, اصحاح, تكوين, خروج, لاويين, عدد, تثنيه, يشوع, قضاه, راعوث, صموئيل, ملوك, اخبار الايام, عزرا, نحميا, استير, ايوب, مزامير, مزمور, امثال, جامعه, نشيد الانشاد, اشعياء, ارميا, مراثي ارميا, حزقيال, دانيال, هوشع, يوئيل, عاموس, عوبديا, يونان, ميخا, ناحوم, حبقوق, صفنيا, حجي, زكريا, ملاخي, متى, مرقس, لوقا, يوحنا, اعمال الرسل, روميه, كورنثوس, غلاطيه, افسس, فيلبي, كولوسي, تسالونيكي, تيموثاوس, تيطس, فليمون, عبرانيين, يعقوب, بطرس, يهوذا, رؤيا, انجيل, بولس, رساله",
    "ta3lim": "وعظه, تعليم, تامل, توبه, خدمه, محبه, فضيله, اباء, نتعلم, دروس",
    "school": "school, مدرسة الشمامسة, عن المدرسة, كتب المدرسة, مناهج المدرسة, كتب ومناهج, اشعارات, إشعارات, notifications, كلمنا",
}
# Words of a domain that alone tell little, and the words of the router's later rules.
AMBIGUOUS = "خدمه, محبه, فضيله, اباء"
FEASTS = "عيد, اعياد, الميلاد, الغطاس, القيامه, التجسد"
COMMEMORATION = "استشهاد, نياحه, تذكار"
DEPARTURE, SAINT_TITLES = "شهاده, موت, انتقال", "قديس, قديسه, شهيد, شهيده, انبا, البابا, مار"
INTERPRETATION = "معني, نتعلم, دروس, تامل"
EUCHARIST = "افخارستيا, الافخارستيا"
ORTHODOXY, LOOKUP = "ارثوذكسيه, الارثوذكسيه", "من هو, من هي, بطل, مصباح, حامي, المعترف, مجمع, عقيدة, هرطقة"
MONASTIC = "رهبنه, رهبان, راهب, اديره, دير, نسك"
OFFICES = "والي, الوالي"
WHO, EPITHET = "مين هو, من هو, مين هي, من هي", "اتسمي, لقب, الملقب, المعروف باسم"
AUTHORSHIP = "واضع, من وضع, مين وضع, مين اللي وضع, مولف, من الف, مين الف"
# Words that queries ignore, and the words of the retrieval gates.
STOP = "ايه, ما, ماذا, مين, من, هو, هي, اللي, الذي, التي, عن, في, على, الى, اين, ازاي, كيف, هل, كان, كانت, ذكر, ذكرت, المذكور, المذكوره, الكتاب, المقدس"
HYMN = "لحن, الحان, hymn, tune, melody"
BOUNDARY = "يبدأ, يبدء, بيبدأ, بيبدء, نبدأ, نبدء, يبتدي, بيبتدي, أول حاجة, أول جزء, ينتهي, بينتهي, يخلص, بيخلص, آخر حاجة, آخر جزء"
VERSE = "verse, verses, آية, آية بتقول, آية اللي, آيات, شاهد, الشاهد, فين الآية, معنى آية"
IDENTITY = "مين هو, من هو, مين هي, من هي, اتسمي, لقب, والي"
CARTOON = "cartoon, كارتون, فيديو كارتون, فيلم كارتون"
SAYINGS = "quote, quotes, قول, أقوال, اقوال, مقولة, قال القديس, قال الأب, قال الاب"
DAY_BOOK = "سنكسار, النهاردة, بكرة, مين هو, من هو, مين هي, من هي"
OPTIONAL = ("about", "aqwal", "cartoon", "coptic", "seneksar")
FALLBACKS = {"al7an": ("taqs", "bible", "ta3lim"), "coptic": ("tari5", "ta3lim", "taqs"), "school": ("ta3lim", "bible", "taqs"), "saints": ("tari5", "ta3lim")}
DEFAULT_DOMAINS = ("ta3lim", "bible", "taqs")
TOMORROW, TODAY = "بكره, بكرة, غدا, غداً, tomorrow", "النهارده, النهاردة, اليوم, today"

_FOLD = str.maketrans(T.FOLD_FROM, T.FOLD_TO)


def normal(term: str, marks: str = T.DIACRITICS) -> str:
    """A term as `T.normalize_search` writes it (with `T.INGEST_DIACRITICS` as the router does), in lower case."""
    x = re.sub(marks, "", unicodedata.normalize("NFKC", term)).translate(_FOLD)
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in x).strip().lower()


def words(listed: str, marks: str = T.DIACRITICS) -> list[str]:
    """The terms of a list in their normal form."""
    return [re.sub(r"\s+", " ", normal(w, marks)) for w in listed.split(", ")]


def stop_words() -> frozenset[str]:
    """The ignored words, with and without their article."""
    bare = lambda w: w[2:] if w.startswith(T.ARTICLE) and len(w) > 3 else w
    return frozenset(x for w in words(STOP) for x in (w, bare(w)))
