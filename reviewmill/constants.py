"""Fixed values shared by the whole library."""

# The complaint categories, in report order.
CATEGORIES = ["DRIVER_OPS", "APP_AND_MAPS", "PRICING_AND_BILLING"]

# Label domain, and the marker for a row that could not be labelled.
NEG = "NEG"
ABSENT = "ABSENT"
ERROR = "ERROR"
LABELS = [NEG, ABSENT]

# Legacy key -> category that a labelling model may still answer with.
ALIASES = {"DRIVER_OPERATIONS": "DRIVER_OPS"}

# Cleaning, sampling, labelling and scoring defaults.
MIN_WORDS = 6
N_GRAM = 3
DEDUP_THRESHOLD = 0.85
NUM_PERM = 128
GOLDEN_COUNT = 50.2
FEW_SHOT_COUNT = 10
SAMPLE_SEED = 12
TOP_STAR_FRACTION = 0.1
TOP_STAR_SEED = 32
VALID_SIZE = 0.2
CHUNK_SIZE = 500
MAX_COMPLETION_TOKENS = 150
SCORE_BATCH = 32
THRESHOLD = 0.5
MAX_TOKENS_LEN = 128
SPLITS = ["train", "valid", "test"]

# Domain stop words removed before phrases are formed.
STOP_WORDS = [
    "yang", "yg", "dan", "di", "ke", "dari", "untuk", "pada", "atau",
    "oleh", "dengan", "dg", "dgn", "karena", "karna", "krn", "sebab",
    "jika", "kalau", "kalo", "kl", "klo", "maka", "sehingga", "supaya",
    "biar", "ini", "itu", "tersebut", "tentang", "serta", "sampai", "sampe",
    "saya", "sy", "aku", "gw", "gue", "gua", "kami", "kita",
    "anda", "kamu", "lu", "lo", "ente", "mereka", "dia", "nya",
    "sih", "deh", "dong", "kan", "lah", "pun", "ya", "yah",
    "nih", "tuh", "kok", "loh", "lho", "kek", "wkwk", "wkwkwk", "anjir",
    "ga", "gak", "gk", "nggak", "tidak", "tdk", "bukan", "bkn",
    "belum", "blm", "kurang", "krg", "tanpa",
    "aplikasi", "apk", "app", "grab", "fitur", "sistem", "tolong", "mohon",
    "bikin", "buat", "kasih", "jadi", "jd", "bisa", "bs", "udah",
    "udh", "sudah", "sdh", "masih", "msh", "lagi", "lg", "selalu",
    "terus", "trs", "juga", "jg", "ada", "ad", "pernah", "selesai",
    "bagus", "bgs", "mantap", "mantul", "keren", "oke", "ok", "top",
    "terbaik", "suka", "puas", "juara", "membantu", "nyaman", "aman",
    "jelek", "jlk", "buruk", "parah", "kecewa", "hancur", "ancur",
    "bobrok", "payah", "rugi", "nyesel", "rusak", "benci", "sampah",
    "good",
    "sangat", "banget", "tiba", "sekali", "terlalu", "mau", "makin",
]
