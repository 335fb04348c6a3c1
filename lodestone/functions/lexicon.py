"""Word lists and tables that search results depend on."""

from __future__ import annotations

#: Arabic letters, and Arabic and Persian digits, and what they fold to.
FOLDS = {"ا": "أإآٱٲٳٵ", "ي": "ىئیېۍﻯ", "و": "ؤۇۋ", "ه": "ةھہ", "ك": "کڪګ"} | {str(i): a + b for i, (a, b) in enumerate(zip("٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", strict=True))}
#: Invisible signs; diacritics with the tatweel; what may stand between the letters of a loose match.
INVISIBLE = "[\u200b-\u200f\u202a-\u202e\u2060\u061c\ufeff]"
MARKS = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640]"
BETWEEN = "[\u064b-\u065f\u0640\u200b-\u200f]*"

#: Words that indexed texts and logged keywords leave out.
STOP_WORDS = """
i me my we our you your he she it they them what which who this that these those am is are was were be been have
has had do does did will would could should may might can a an the and but or in on at to for of with by from
up about into get got use want make
في من إلى على عن مع هذا هذه ذلك هو هي هم أنا أنت نحن التي الذي كان أن لكن أو و ثم قد لم لن ما لا
""".split()

#: Words that a typed query leaves out.
QUERY_STOP_WORDS = """
i me my we our you your he she it its they them their what which who this that these those am is are was were be been
being have has had do does did will would could should may might shall can need dare ought a an the and but or nor for
yet so in on at to of with by from up about into through during before after above below between out off over then
once here there when where why how all both each more most other some such than too very just because as until while
although if not no get got also back use used using want make like know think look go best good great top new free easy
في من إلى على عن مع هذا هذه ذلك تلك هو هي هم هن أنا أنت نحن التي الذي الذين كان كانت يكون أن لأن لكن أو و ثم قد لقد لم
لن ما لا إن إذا حتى بعد قبل عند كل بعض أي
""".split()

#: Words of clicked texts that tell nothing of a user's taste.
NEUTRAL_WORDS = "new best sale price free latest top cheap deal offer discount buy shop shipping delivery affordable compare guide review tutorial".split()

#: Weighted signals of each intent, and the data types that each favours.
INTENTS = {
    "buy": {
        2.0: "buy purchase order price shipping delivery شراء اشتري سعر أسعار ثمن توصيل شحن",
        1.5: "cost cheap afford affordable discount deal offer sale shop store sell تكلفة رخيص خصم عرض طلب",
        1.0: "stock",
    },
    "repair": {
        2.0: "repair fix service maintenance book booking appointment إصلاح تصليح صيانة خدمة خدمات حجز موعد",
        1.5: "broken damage replace support schedule hire rent install setup consult doctor hotel ticket تركيب استشارة",
        1.0: "screen battery help",
    },
    "compare": {
        2.0: "vs versus compare comparison difference مقارنة الفرق",
        1.5: "better alternative between which choose pros cons أفضل بين أم",
        1.0: "best top rating rank ranked",
    },
    "learn": {
        2.0: "how tutorial guide learn كيف شرح دليل تعلم",
        1.5: "what why explain introduction overview meaning definition example course review documentation ماذا لماذا مقدمة مفهوم تعريف مراجعة",
        1.0: "tips tricks article blog news أخبار",
        0.5: "update",
    },
}
INTENTS = {intent: {w: weight for weight, words in by.items() for w in words.split()} for intent, by in INTENTS.items()}
INTENT_TYPES = {
    "buy": ("products", "product", "items", "goods"),
    "repair": ("services", "service", "booking", "appointments"),
    "learn": ("articles", "article", "posts", "blog", "news"),
    "compare": ("articles", "article", "posts", "blog", "products", "product"),
    "product": ("products", "product", "items", "goods"),
    "article": ("articles", "article", "posts", "blog", "news"),
    "service": ("services", "service", "booking", "appointments"),
}

#: Phrases that exclude what follows, and words that ask for nothing.
NEGATIONS = {
    "en": ("not including", "other than", "aside from", "apart from", "excluding", "without", "except", "exclude", "minus", "not", "no"),
    "ar": (
        "لا اريد ان", "لا أريد ان", "لا ابغى ان", "لا أبغى ان", "مش عايزة ان", "ما بدي", "ما اريد", "ما أريد", "ما ابغى", "ما أبغى", "لا اريد", "لا أريد", "لا ابغى", "لا أبغى",
        "مش عايز", "مش عايزة", "مو بادي", "مو عايز", "بدون", "بدوني", "غير", "ماعدا", "سوى", "عدا", "إلا", "الا", "مبغاش", "مابغاش", "without", "except",
    ),
}
FILLERS = {
    "en": "want need looking find show please give tell help get searching search buy for me a an the some any".split(),
    "ar": "بدي ودي ابي أبي نفسي محتاج محتاجة حابب حابة عايز عايزة ابغى أبغى اريد أريد ابغاه ابيه بغيت عندي يا هلا ممكن لو فيه وين want need looking find show please give tell help get".split(),
}

#: At most two synonyms of a word, in order; a word or phrase after the colon each.
SYNONYMS = """
phone: mobile, cellphone
mobile: phone, cellphone
cellphone: phone, mobile
iphone: apple phone, ios phone
smartphone: mobile, phone
laptop: notebook, computer
notebook: laptop, computer
computer: pc, desktop
pc: computer, desktop
tablet: ipad, device
ipad: tablet, apple tablet
tv: television, screen
television: tv, screen
watch: smartwatch, wearable
smartwatch: watch, wearable
headphone: earphone, headset
earphone: headphone, earbud
earbud: earphone, headphone
camera: dslr, photography
cheap: affordable, budget
affordable: cheap, budget
offer: deal, discount
deal: offer, discount
discount: offer, sale
sale: discount, offer
buy: purchase, order
purchase: buy, order
price: cost, rate
cost: price, rate
shop: store, market
store: shop, market
article: post, blog
post: article, blog
blog: article, post
news: article, update
tutorial: guide, howto
guide: tutorial, manual
manual: guide, documentation
docs: documentation, manual
documentation: docs, manual
review: rating, feedback
rating: review, score
feedback: review, comment
category: section, group
section: category, part
product: item, goods
item: product, goods
service: solution, offering
جوال: هاتف, موبايل
هاتف: جوال, موبايل
موبايل: جوال, هاتف
ايفون: ابل, هاتف ذكي
هاتف ذكي: ايفون, موبايل
لابتوب: حاسوب, كمبيوتر
حاسوب: لابتوب, كمبيوتر
كمبيوتر: حاسوب, لابتوب
تابلت: آيباد, لوحي
آيباد: تابلت, لوحي
شاشة: تلفزيون, ديسبلاي
تلفزيون: شاشة, تلفاز
تلفاز: تلفزيون, شاشة
سماعة: هيدفون, ايربود
كاميرا: تصوير, عدسة
عرض: خصم, تخفيض
خصم: عرض, تخفيض
تخفيض: خصم, عرض
سعر: تكلفة, ثمن
ثمن: سعر, تكلفة
شراء: طلب, اقتناء
متجر: محل, سوق
محل: متجر, سوق
مقال: منشور, محتوى
منشور: مقال, محتوى
دليل: شرح, توضيح
شرح: دليل, توضيح
مراجعة: تقييم, رأي
تقييم: مراجعة, تقرير
أخبار: مستجدات, تحديثات
تحديث: أخبار, جديد
"""
SYNONYMS = {k.strip(): [w.strip() for w in v.split(",")] for k, _, v in (line.partition(":") for line in SYNONYMS.strip().splitlines())}

#: Arabic words and their English counterparts; the other direction follows from it.
TRANSLITERATIONS = """
ايفون: iphone
ابل: apple
سامسونج: samsung
سامسونغ: samsung
جالكسي: galaxy
جوال: phone, mobile
هاتف: phone, mobile
موبايل: mobile, phone
نوكيا: nokia
هواوي: huawei
شاومي: xiaomi
اوبو: oppo
ريلمي: realme
بيكسل: pixel
جوجل: google
اندرويد: android
برو: pro
ماكس: max
بلس: plus
الترا: ultra
ميني: mini
لابتوب: laptop
حاسوب: computer, pc
كمبيوتر: computer, pc
ماك: mac
ماكبوك: macbook
ايباد: ipad
تابلت: tablet
لوحي: tablet
شاشه: screen, display
تلفزيون: tv, television
تلفاز: tv, television
كاميرا: camera
ساعه: watch
سماعه: headphone, earphone
سماعات: headphones, earphones
ايربودز: airpods
شاحن: charger
بطاريه: battery
كفر: case, cover
غطاء: cover, case
طابعه: printer
راوتر: router
سعر: price
اسعار: prices, price
تكلفه: cost, price
ثمن: price
شراء: buy, purchase
اشتري: buy
رخيص: cheap, affordable
ارخص: cheap, affordable
غالي: expensive
خصم: discount, sale
عرض: offer, deal
عروض: offers, deals
تخفيض: discount, sale
متجر: store, shop
توصيل: delivery, shipping
شحن: shipping, delivery
مجاني: free
تقسيط: installment
ضمان: warranty
مقال: article, post
مقالات: articles, posts
اخبار: news
دليل: guide
شرح: tutorial, guide
مراجعه: review
تقييم: rating, review
خدمه: service
خدمات: services
حجز: booking, reservation
صيانه: repair, maintenance
تصليح: repair, fix
منتج: product, item
منتجات: products, items
"""
TRANSLITERATIONS = {k.strip(): [w.strip() for w in v.split(",")] for k, _, v in (line.partition(":") for line in TRANSLITERATIONS.strip().splitlines())}

#: Common misspellings of a word, and words that are right.
TYPOS = """
iphone: iphoen ipone iphon iphne ifone iphonr iohone iphoe iphoone iphobe
apple: aipple aplpe appel aplle
macbook: macbok makbook macboo macbbok
samsung: samsng samsong sasmung smasung samsnug samsumg samsug samsun
galaxy: galxy gallaxy galaxi glaxy
google: googel gogle gooogle googl
pixel: pixle pxiel pixal pxel
laptop: laptp labtop leptop laptob latpop lpatop laptoop laotop
tablet: tabelt tabet tablat tabler
headphone: headfone hedphone
earphone: earphon erafone
phone: phoen fone phon pone
nokia: nokea nokiya nokai nkia
huawei: huaewi hawuei huawai hauwei
xiaomi: xiomi xaomi shaomi xiaommi
cheap: cheep chep
price: prie prcie rpice prise
wireless: wireles
bluetooth: bluetoth
charger: chager
battery: baterry batery
camera: camra camear
screen: screeen
android: androd androied
"""
TYPOS = {wrong: right.strip() for right, _, words in (line.partition(":") for line in TYPOS.strip().splitlines()) for wrong in words.split()}
KNOWN_WORDS = """
iphone samsung apple google pixel galaxy laptop macbook tablet android huawei xiaomi nokia oppo phone mobile screen camera
battery charger wireless bluetooth headphone earphone watch airpods computer keyboard monitor printer router speaker cheap price
""".split()
#: The words that a misspelling is measured against, by the length under which each is looked up.
TYPO_TARGETS = {
    4: "oppo sony",
    5: "apple nokia pixel phone cheap price",
    6: "iphone laptop tablet camera screen galaxy mobile",
    7: "samsung android airpods battery charger monitor printer speaker router huawei",
    8: "macbook computer keyboard wireless xiaomi",
    9: "bluetooth headphone",
    10: "earphone",
}
TYPO_TARGETS = {n: words.split() for n, words in TYPO_TARGETS.items()}

#: What each key of the English layout gives on the Arabic one; capitals are the keys with shift.
KEYS = {
    "q": "ض", "w": "ص", "e": "ث", "r": "ق", "t": "ف", "y": "غ", "u": "ع", "i": "ه", "o": "خ", "p": "ح", "a": "ش", "s": "س", "d": "ي", "f": "ب", "g": "ل", "h": "ا", "j": "ت", "k": "ن",
    "l": "م", ";": "ك", "z": "ئ", "x": "ء", "c": "ؤ", "v": "ر", "b": "لا", "n": "ى", "m": "ة", ",": "و", ".": "ز", "Q": "َ", "W": "ً", "E": "ُ", "R": "ٌ", "T": "لإ", "Y": "إ", "U": "`",
    "I": "÷", "O": "×", "P": "؛", "A": "ِ", "S": "ٍ", "D": "]", "F": "[", "G": "لأ", "H": "أ", "J": "ـ", "K": "،", "L": "/", "Z": "~", "X": "ْ", "C": "}", "V": "{", "B": "لآ", "N": "آ", "M": "'",
}

#: Names that entities are recognised by.
BRANDS = """
apple samsung google microsoft sony lg huawei xiaomi oppo vivo oneplus nokia dell hp lenovo asus acer toshiba
toyota honda bmw mercedes audi ford hyundai kia nissan volkswagen chevrolet ابل سامسونج هواوي شاومي
""".split()
PLACES = "romania egypt saudi uae dubai riyadh cairo london paris berlin usa uk germany مصر السعودية الإمارات دبي الرياض القاهرة".split()
PLACE_SIGNS = "in at near from around في بـ قرب من".split()
MODELS = (r"\b(\d{1,2}(?:\s+(?:pro|max|ultra|plus|lite|mini|edge))+)\b", r"\b([a-z]\d+(?:\s+(?:pro|max|ultra|plus|lite))?)\b", r"\bseries\s+(\d+)\b")
PRICE_MOST = r"(?:under|less than|below|أقل من|تحت)\s+(\d+)"
PRICE_LEAST = r"(?:over|more than|above|أكثر من|فوق)\s+(\d+)"
PRICE_RANGE = r"(\d+)\s+(?:to|-|and)\s+(\d+)"
COLOURS = {w: w for w in "red blue black white green gold silver pink purple".split()} | {"أحمر": "red", "أزرق": "blue", "أسود": "black", "أبيض": "white", "ذهبي": "gold", "فضي": "silver"}
STORAGE = ("64gb", "128gb", "256gb", "512gb", "1tb")

#: Routing keys of the notification queue.
NOTIFICATIONS = """
auth.user.registered auth.otp.sent auth.otp.resent
booking.booking.created booking.booking.cancelled booking.booking.rescheduled
ecommerce.order.created ecommerce.order.paid ecommerce.order.shipped ecommerce.order.delivered ecommerce.order.cancelled
ecommerce.payment.paid ecommerce.payment.failed ecommerce.payment.refunded
ecommerce.return_request.created ecommerce.return_request.approved ecommerce.return_request.rejected
cms.subscription.created cms.subscription.renewed cms.subscription.cancelled cms.subscription.grace_period cms.subscription.expired
cms.payment.paid cms.payment.failed cms.payment.refunded
cms.installment.paid cms.installment.completed cms.installment.defaulted
cms.project.created
""".split()
