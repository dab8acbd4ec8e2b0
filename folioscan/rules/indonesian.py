"""Default rule data for Indonesian theses.

Everything here is data handed to the operators through :class:`RuleSet`; no
operator names a word of it.  Another corpus brings another ``RuleSet``.
"""

from __future__ import annotations

from folioscan.rules.model import FileRule, RuleSet, Topic

# ---------------------------------------------------------------------------
# These word lists and patterns decide the results and must stay
# as they are.
# ---------------------------------------------------------------------------

TOPICS = (
    Topic(
        name="RAD",
        label="RAD",
        mention=(r"\brad\b", r"rapid application development", r"rapidapplicationdevelopment"),
        id_hints=("_rad", "rad"),
        strict=(r"\brad\b", r"rapid application development", r"\bmetode\s+rad\b"),
        strong=(
            r"\b(?:metode|model)\s+(?:rapid\s+application\s+development|rad)\b",
            r"\b(?:rapid\s+application\s+development|rad)\b\s+(?:adalah|merupakan|digunakan)\b",
            r"\btahapan?\b[^.\n]{0,80}\b(?:rapid\s+application\s+development|rad)\b",
            r"\b(?:rapid\s+application\s+development|rad)\b[^.\n]{0,80}\btahapan?\b",
            r"\blangkah(?:-langkah)?\b[^.\n]{0,80}\b(?:rapid\s+application\s+development|rad)\b",
        ),
        style=(r"\bcepat\b", r"\bfleksibel\b", r"\bincremental\b", r"\bwaktu\s+pengembangan\b"),
        style_summary="ditonjolkan sebagai metode yang mendukung pengembangan sistem yang cepat/fleksibel.",
    ),
    Topic(
        name="PROTOTYPING",
        label="Prototyping",
        mention=(
            r"\bprototyp\w*\b",
            r"\bprototype\b",
            r"\bmodel\s+prototyp\w*\b",
            r"\bmetode\s+prototyp\w*\b",
        ),
        id_hints=("prototyp",),
        strict=(
            r"\bprototyping\b",
            r"\bmetode\s+prototyp",
            r"\bmodel\s+prototyp",
            r"\bpendekatan\s+prototyp",
        ),
        strong=(
            r"\b(?:metode|model)\s+prototyp(?:e|ing)\b",
            r"\bprototyp(?:e|ing)\b\s+(?:adalah|merupakan|digunakan)\b",
            r"\btahapan?\b[^.\n]{0,80}\bprototyp(?:e|ing)\b",
            r"\bprototyp(?:e|ing)\b[^.\n]{0,80}\btahapan?\b",
            r"\blangkah(?:-langkah)?\b[^.\n]{0,80}\bprototyp(?:e|ing)\b",
        ),
        style=(
            r"\bprototype\b",
            r"\bprototipe\b",
            r"\bevaluasi\b",
            r"\bkebutuhan\s+pengguna\b",
            r"\bsesuai\s+kebutuhan\b",
        ),
        style_summary="ditonjolkan melalui pembuatan serta evaluasi prototipe sesuai kebutuhan pengguna.",
        strict_only=True,
    ),
    Topic(
        name="RUP",
        label="RUP",
        mention=(r"\brup\b", r"rational unified process", r"rationalunifiedprocess"),
        id_hints=("_rup", "rup"),
        strong=(r"\brup\b",),
    ),
    Topic(
        name="EXTREME_PROGRAMMING",
        label="Extreme Programming",
        mention=(
            r"extreme\s*programming",
            r"extreme[_\-\s]*programming",
            r"extremeprogramming",
            r"\bxp\b",
        ),
        id_hints=("extremeprogramming", "extreme_programming", "xp"),
        strong=(
            r"\b(?:metode|model)\s+extreme\s+programming\b",
            r"\bextreme\s+programming\b\s+(?:adalah|merupakan|digunakan)\b",
            r"\b(?:metode|model)\s+xp\b",
            r"\bxp\b\s+(?:adalah|merupakan|digunakan)\b",
        ),
        aliases=("XP",),
    ),
    Topic(
        name="WATERFALL",
        label="Waterfall",
        mention=(r"\bwaterfall\b",),
        id_hints=("waterfall",),
        strong=(
            r"\b(?:metode|model)\s+waterfall\b",
            r"\bwaterfall\b\s+(?:adalah|merupakan|digunakan)\b",
        ),
    ),
    Topic(
        name="AGILE",
        label="Agile",
        mention=(r"\bagile\b", r"\bscrum\b"),
        id_hints=("agile", "scrum"),
        strong=(r"\bagile\b",),
        aliases=("Scrum",),
    ),
)

# topic, then lists of patterns: one of every list must occur
FREE_TEXT_TOPICS = (
    ("RAD", (r"rad", r"rapid application development")),
    ("RAD", (r"\b(planning|perencanaan)\b",), (r"\b(design|perancangan)\b",)),
    ("RAD", (r"\bimplementation|implementasi\b",)),
    ("PROTOTYPING", (r"\bprototyp", r"prototipe")),
    ("EXTREME_PROGRAMMING", (r"extreme programming", r"\bxp\b")),
    (
        "EXTREME_PROGRAMMING",
        (r"pair programming|continuous integration|refactor|test[- ]driven",),
    ),
)

# changed from the original values: "_" counts as a blank, as part files such as X_Bab_1 need
FILE_RULES = (
    FileRule(r"daftar[\s\-]*pustaka", "sitasi", "DAFTAR_PUSTAKA"),
    FileRule(r"daftar[\s\-]*referensi", "sitasi", "DAFTAR_PUSTAKA"),
    FileRule(r"\breference", "sitasi", "DAFTAR_PUSTAKA"),
    FileRule(r"\bbibliograph", "sitasi", "DAFTAR_PUSTAKA"),
    FileRule(r"\bbab[\s\-]*viii\b", "narasi", "UNKNOWN"),
    FileRule(r"\bbab[\s\-]*vii\b", "narasi", "UNKNOWN"),
    FileRule(r"\bbab[\s\-]*vi\b", "narasi", "UNKNOWN"),
    FileRule(r"\bbab[\s\-]*iv\b", "narasi", "BAB_IV"),
    FileRule(r"\bbab[\s\-]*v\b", "narasi", "BAB_V"),
    FileRule(r"\bbab[\s\-]*iii\b", "narasi", "BAB_III"),
    FileRule(r"\bbab[\s\-]*ii\b", "narasi", "BAB_II"),
    FileRule(r"\bbab[\s\-]*i\b", "narasi", "BAB_I"),
    FileRule(r"\bbab[\s\-]*1\b", "narasi", "BAB_I"),
    FileRule(r"\bbab[\s\-]*2\b", "narasi", "BAB_II"),
    FileRule(r"\bbab[\s\-]*3\b", "narasi", "BAB_III"),
    FileRule(r"\bbab[\s\-]*4\b", "narasi", "BAB_IV"),
    FileRule(r"\bbab[\s\-]*5\b", "narasi", "BAB_V"),
    FileRule(r"halaman[\s\-]*depan", None, "SKIP"),
    FileRule(r"halaman[\s\-]*awal", None, "SKIP"),
    FileRule(r"\bcover\b", None, "SKIP"),
    FileRule(r"halaman[\s\-]*judul", None, "SKIP"),
    FileRule(r"\blampiran\b", None, "SKIP"),
    FileRule(r"\bappendix\b", None, "SKIP"),
    FileRule(r"\babstrak\b", None, "SKIP"),
    FileRule(r"\babstract\b", None, "SKIP"),
    FileRule(r"kata[\s\-]*pengantar", None, "SKIP"),
    FileRule(r"daftar[\s\-]*isi", None, "SKIP"),
    FileRule(r"daftar[\s\-]*gambar", None, "SKIP"),
    FileRule(r"daftar[\s\-]*tabel", None, "SKIP"),
    FileRule(r"\bpengesahan\b", None, "SKIP"),
    FileRule(r"\bpernyataan\b", None, "SKIP"),
)

PATTERNS = {
    # chapter headers
    "chapter_line": r"^BAB\s+(VIII|VII|VI|IV|V|III|II|I|[1-9])\b",
    "chapter_alone": r"^BAB$",
    "numeral_line": r"^(VIII|VII|VI|IV|V|III|II|I|[1-9])\b",
    "bibliography_line": r"^(?:DAFTAR\s+(?:PUSTAKA|REFERENSI)|REFERENCES?|BIBLIOGRAPHY)$",
    "appendix_line": r"^(?:LAMPIRAN|APPENDIX|APPENDICES)\b",
    # document metadata
    "title_block": (
        r"skripsi|tugas\s+akhir|tesis|disertasi|thesis"
        r"|universitas|fakultas|jurusan|program\s+studi|prodi"
        r"|nim\b|nip\b|nidn\b|oleh\b|disusun|diajukan"
        r"|sarjana|diploma|strata|gelar"
        r"|halaman|cover|lembar"
        r"|persetujuan|pengesahan|pernyataan|keaslian"
        r"|kata\s+pengantar|daftar\s+isi|abstrak|abstract"
        r"|pembimbing|penguji|dekan|ketua"
    ),
    "year": r"\b(20\d{2})\b",
    "author_trigger": r"^(?:oleh|disusun\s+oleh|dibuat\s+oleh|nama)\s*:?\s*$",
    "author_inline": r"(?:oleh|disusun\s+oleh|dibuat\s+oleh|nama)\s*:\s*(.+)",
    "student_number": r"\bnim\b|\bnip\b",
    "program_trigger": r"^(?:jurusan|program\s+studi|prodi|departemen|department)\s*:?\s*$",
    "program_inline": r"(?:jurusan|program\s+studi|prodi|departemen|department)\s*:?\s*(.+)",
    # questions
    "q_topic": r"\b(metode|model)\b",
    "q_steps": r"\b(tahap|tahapan)\w*\b|\blangkah\w*\b",
    "q_flow": r"\b(alur|prosedur)\w*\b",
    "q_flow_context": r"\b(sistem|pengembangan|aplikasi|software|perangkat\s*lunak|metode\s+pengembangan|sdlc)\b",
    "q_anaphora": r"\b(itu|tersebut|ini|nya|tahapannya|langkahnya|alur\s*nya|metodenya)\b",
    "q_count": r"\b(ada\s+berapa|berapa\s+(skripsi|dokumen|file)|jumlah\s+(skripsi|dokumen|file)|adakah)\b",
    "q_listing": (
        r"\b(sebutkan|daftarkan|tampilkan|skripsi\s+yang\s+menggunakan|dokumen\s+yang\s+menggunakan"
        r"|judul(?:nya)?|penulis(?:nya)?)\b"
    ),
    "q_compare": r"\b(perbedaan|perbandingan|bandingkan|dibandingkan)\b",
    "q_compare_join": r"\b(vs|versus|dan|&|antara)\b",
    "q_identify": (
        r"\b(metode|model)\b.*\b(apa|apakah)\b|\bapa\b.*\b(metode|model)\b|\bmenggunakan\b.*\bmetode\s+apa\b"
    ),
    "q_multi_doc_extra": (
        r"\b(beberapa\s+skripsi|di\s+beberapa\s+skripsi|dokumen\s+skripsi\s+yang\s+ada|lintas\s+dokumen)\b"
    ),
    "q_title_field": r"\bjudul(?:nya)?\b",
    "q_author_field": r"\bpenulis(?:nya)?\b",
    "q_page_count": r"\b(jumlah|berapa)\b.*\bhalaman\b|\bpage\s*count\b",
    "q_doc_after_noun": r"\b(?:dokumen|file|pdf|skripsi)\s+([a-z0-9][a-z0-9 _\-/]{1,100})",
    "q_history_context": r"\b(tahap|tahapan|langkah|alur|prosedur)\w*\b",
    "q_list_form": r"\bapa\s+saja\b",
    "q_answer_compare": r"\b(perbedaan|beda|bandingkan|dibandingkan|versus|vs)\b",
    "q_pronoun": r"\b(itu|tersebut|ini|nya)\b",
    # metadata in a question (rule-based split)
    "f_year": r"\b(?:tahun|thn|angkatan)\s*:?\s*(\d{4}(?:\.0)?)\b",
    "f_program": r"\b(?:prodi|jurusan|program\s+studi)\s+([A-Za-z][A-Za-z ]*?)(?=\s+(?:tahun|thn|angkatan|oleh|karya|yang|tentang|dengan|pada)\b|[,.?!;:]|$)",
    "f_author": r"\b(?:karya|oleh|penulis)\s+([A-Za-z][A-Za-z .']*?)(?=\s+(?:tahun|thn|angkatan|prodi|jurusan|yang|tentang|dengan|pada)\b|[,?!;:]|$)",
    "doc_id_style": r"\b[A-Z]{2,}_\d{4}_[A-Za-z0-9_]+\b",
    # step signals
    "steps_word": r"\b(tahap|tahapan|langkah|prosedur|fase)\w*\b",
    "list_connector": r"\b(meliputi|terdiri(\s+dari)?|yaitu|antara\s+lain)\b",
    "list_after_connector": r"\b(meliputi|terdiri(\s+dari)?|yaitu|antara\s+lain)\b\s*([^\.]{20,280})",
    "list_split": r",|\bdan\b",
    "caption": r"^\s*(gambar|tabel)\s+\d+\.\d+\b",
    # answers
    "not_found_sentence": "tidak ditemukan pada dokumen",
}

PATTERN_LISTS = {
    "citation": (
        r"\b(referensi|daftar\s*pustaka|daftar\s*referensi)\b",
        r"\b(jurnal|buku|artikel|publikasi|acuan|sitasi)\b.*\b(digunakan|dijadikan|ada|apa)\b",
        r"\b(apa|sebutkan|tampilkan|cari)\b.*\b(jurnal|buku|referensi|pustaka|acuan)\b",
        r"\b(landasan\s*teori|tinjauan\s*pustaka|kajian\s*literatur)\b",
        r"\b(mengutip|dikutip|menggunakan\s+referensi|sumber\s+pustaka)\b",
        r"\b(cited|citation|bibliography|references?)\b",
    ),
    "explain": (
        r"\bjelaskan\b",
        r"\bpenjelasan\b",
        r"\bdigunakan\s+seperti\s+apa\b",
        r"\bbagaimana\b[^\n]{0,40}\bdigunakan\b",
        r"\balasan\b[^\n]{0,20}\bmenggunakan\b",
        r"\bkarakteristik\b",
        r"\bkonteks\b[^\n]{0,20}\bpenggunaan\b",
        r"\bterkait\b",
    ),
    "multi_target": (
        r"\b(semua|masing-masing|masing|setiap|beberapa)\b.*\b(metode|model)\b",
        r"\b(rad|rapid application development)\b.*\b(dan|&)\b.*\b(proto|prototyp)",
    ),
    "multi_doc": (r"\b(beberapa|berbagai|multi)\b.*\b(dokumen|sumber)\b",),
    "compression": (
        r"\blebih\s+ringkas(?:\s+lagi)?\b",
        r"\blebih\s+singkat(?:\s+lagi)?\b",
        r"\bsingkatnya\b",
        r"\bversi\s+ringkas\b",
        r"\binti(?:nya)?\b",
        r"\bpoin\s+utamanya\b",
        r"\blangkah\s+utama(?:nya)?\b",
        r"\btahap(?:an)?\s+utama(?:nya)?\b",
    ),
    "owner_cue": (
        r"\bpenelitian\s+ini\s+(?:menggunakan|memakai|menerapkan)\b",
        r"\bdalam\s+penelitian\s+ini\b",
        r"\bpengembangan\s+sistem\s+(?:ini\s+)?(?:menggunakan|memakai|menerapkan)\b",
        r"\bsistem\s+ini\s+(?:dikembangkan|dibangun|menggunakan)\b",
        r"\bmetode\b.{0,60}\bdigunakan\s+dalam\s+penelitian\s+ini\b",
        r"\bmetode\b.{0,60}\bdigunakan\s+karena\b",
        r"\bpenulis\s+(?:menggunakan|menerapkan)\b",
    ),
    "related_work": (
        r"\bpenelitian\s+terdahulu\b",
        r"\bstudi\s+terdahulu\b",
        r"\bpenelitian\s+sebelumnya\b",
        r"\bberdasarkan\s+penelitian\s+sebelumnya\b",
        r"\bhasil\s+penelitian\s+sebelumnya\b",
        r"\btinjauan\s+pustaka\b",
        r"\blandasan\s+teori\b",
        r"\bperbedaan\s+skripsi\b",
        r"\bno\s+penulis\b",
        r"\bjudul\b.*\btahun\b",
        r"\bstudi\s+kasus\b",
    ),
    "explain_signal": (
        r"\bdigunakan\b",
        r"\bdigunakan\s+karena\b",
        r"\balasan\b",
        r"\bmemungkinkan\b",
        r"\bkelebihan\b",
        r"\bkarakteristik\b",
        r"\bbersifat\b",
        r"\bincremental\b",
        r"\bitera(?:si|tif)?\b",
        r"\btahapan?\b",
        r"\blangkah(?:-langkah)?\b",
        r"\bplanning\b",
        r"\bdesign\b",
        r"\bcoding\b",
        r"\btesting\b",
        r"\bcommunication\b",
    ),
    "steps_bias": (
        r"\btahapan?\b",
        r"\blangkah(?:-langkah)?\b",
        r"\bmekanisme\b",
        r"\bpenjabaran\b",
        r"\balur\b",
        r"\bprosedur\b",
    ),
    "artifact": (
        r"\bdata\s+flow\s+diagram\b",
        r"\bdfd\b",
        r"\bentity\s+relationship\s+diagram\b",
        r"\berd\b",
        r"\buse\s+case\b",
        r"\bactivity\s+diagram\b",
        r"\bsequence\s+diagram\b",
        r"\bclass\s+diagram\b",
        r"\bdeployment\s+diagram\b",
        r"\bcontext\s+diagram\b",
        r"\bflowmap\b",
        r"\bmockup\b",
        r"\brancangan\s+antarmuka\b",
        r"\bblackbox\b",
        r"\bwhitebox\b",
        r"\blaporan\s+magang\b",
        r"\blogsheet\s+magang\b",
    ),
    "compare_noise": (
        r"\bpenelitian\s+terdahulu\b",
        r"\bstudi\s+terdahulu\b",
        r"\bperbedaan\s+skripsi\b",
        r"\bno\s+penulis\b",
        r"\bjudul\b.*\btahun\b",
        r"\bhasil\s+penelitian\b",
    ),
    "compare_usage": (
        r"\bdigunakan\b",
        r"\bmenggunakan\b",
        r"\bmenerapkan\b",
        r"\bpengembangan\s+sistem\b",
        r"\bpenelitian\s+ini\b",
    ),
    "compare_reason": (
        r"\bkarena\b",
        r"\bkelebihan\b",
        r"\bmemungkinkan\b",
        r"\bfleksibel\b",
        r"\bcepat\b",
        r"\bincremental\b",
        r"\befektif\b",
        r"\bsesuai\s+kebutuhan\b",
    ),
    "compare_process": (
        r"\btahapan?\b",
        r"\blangkah(?:-langkah)?\b",
        r"\bplanning\b",
        r"\bdesign\b",
        r"\bcoding\b",
        r"\btesting\b",
        r"\bprototype\b",
        r"\bevaluasi\b",
    ),
    "caution": (
        r"tidak\s+menampilkan[^.\n]{0,80}eksplisit",
        r"tidak\s+dijelaskan[^.\n]{0,80}eksplisit",
        r"tidak\s+disebutkan[^.\n]{0,80}eksplisit",
        r"hanya\s+menyebut",
        r"belum\s+menjelaskan",
        r"coverage\s+masih\s+parsial",
        r"parsial",
        r"asimetris",
    ),
    "title_suspicious": (
        r"^\s*\d+\.\s+",
        r"\bno\s+penulis\b",
        r"\bhasil\s+penelitian\b",
        r"\bperbedaan\s+skripsi\b",
        r"\bjudul\b.*\btahun\b",
        r"\bpenelitian\s+terdahulu\b",
        r"\bstudi\s+terdahulu\b",
    ),
    "cover_file": (r"halaman[_\s\-]*depan", r"halaman[_\s\-]*judul", r"halaman[_\s\-]*awal", r"\bcover\b"),
    "part_file": (
        r"[_\-]bab[_\-\s]",
        r"[_\-]halaman[_\-\s]",
        r"[_\-]daftar[_\-\s]*pustaka",
        r"[_\-]daftar[_\-\s]*referensi",
        r"[_\-]lampiran\b",
        r"[_\-]abstrak\b",
        r"[_\-]penutup\b",
        r"[_\-]kesimpulan\b",
    ),
}

WORD_LISTS = {
    "multi_target_phrases": (
        "semua metode", "masing-masing", "setiap metode", "beberapa metode",
        "dua metode", "kedua metode", "metode rad dan", "rad dan prototyping",
        "prototyping dan rad", "rad & prototyping", "metode apa saja",
        "metode-metode", "masing masing",
    ),
    "multi_doc_phrases": (
        "beberapa dokumen", "dokumen lain", "dokumen lainnya", "berbagai dokumen",
        "lebih dari satu dokumen", "lintas dokumen", "multi dokumen",
        "beberapa sumber", "sumber lain", "di dokumen berbeda",
    ),
    "shift_markers": (
        "topik lain", "topik berbeda", "bahasan lain", "ganti topik",
        "sekarang bahas", "selanjutnya bahas", "ngomongin yang lain",
    ),
    "stage_terms": (
        "planning", "perencanaan", "design", "perancangan",
        "implementation", "implementasi", "coding", "pengkodean",
        "testing", "pengujian", "evaluasi", "deployment",
        "pemeliharaan", "analisis", "desain",
    ),
    "step_item_words": (
        "analisis", "perancangan", "implementasi", "pengujian", "evaluasi",
        "planning", "design", "coding", "testing", "deployment",
        "identifikasi", "pengumpulan", "penerapan", "pemodelan",
        "perencanaan", "pengkodean", "pemeliharaan", "penyebaran",
        "interaksi", "alur data", "prototype", "user interface",
        "kebutuhan", "requirement", "spesifikasi", "review", "feedback",
        "iterasi", "pengembangan sistem", "basis data", "antarmuka",
    ),
    "artifact_words": (
        "data flow diagram", "dfd", "entity relationship diagram", "erd",
        "use case", "activity diagram", "sequence diagram", "class diagram",
        "deployment diagram", "context diagram", "flowmap", "mockup",
        "rancangan antarmuka", "blackbox", "whitebox", "laporan magang",
        "logsheet magang",
    ),
    "research_words": (
        "sistem", "rancang", "bangun", "aplikasi", "pengembangan",
        "monitoring", "e-learning", "learning", "ticketing", "informasi",
        "presensi", "face", "recognition", "website", "penerapan", "perancangan",
        "skripsi", "tugas akhir", "berbasis", "web", "mobile",
    ),
    "institution_words": ("institut teknologi sumatera", "jurusan", "produksi dan industri"),
    "undetected": (
        "", "penulis tidak terdeteksi", "judul tidak terdeteksi",
        "tidak terdeteksi", "unknown", "none", "n/a", "-",
    ),
    "stop_topic": (
        "apa", "yang", "dan", "atau", "dengan", "dalam", "pada", "untuk", "dari",
        "ke", "ini", "itu", "tersebut", "nya", "jelaskan", "sebutkan", "menurut",
        "dokumen", "skripsi", "sistem", "metode", "model", "bab", "tabel", "gambar",
    ),
    "stop_qa": (
        "apa", "apakah", "siapa", "kapan", "dimana", "di", "mana", "bagaimana",
        "mengapa", "kenapa", "yang", "dan", "atau", "dengan", "dalam", "pada",
        "untuk", "dari", "ke", "ini", "itu", "adalah", "menurut", "jelaskan",
        "sebutkan", "minimal", "jika", "ada", "penulis", "penelitian", "skripsi",
        "tugas", "akhir", "bab", "halaman", "gambar", "tabel", "lampiran",
        "dokumen", "paper", "artikel", "jurnal", "konteks", "jawaban", "bukti",
        "metode", "model", "sistem", "pengembangan", "proses", "tahap", "tahapan",
        "langkah", "alur", "prosedur", "memiliki", "punya", "menggunakan",
        "digunakan", "dipakai",
    ),
    "stop_grounding_extra": (
        "jawaban", "bukti", "pertanyaan", "konteks", "digunakan", "dipakai",
        "menggunakan", "penelitian", "dokumen", "beberapa", "lainnya", "lain",
        "metode", "model", "sistem",
    ),
    "stop_support_extra": (
        "jawaban", "bukti", "pertanyaan", "konteks", "sebelumnya", "penelitian",
        "penulis", "dokumen", "sistem", "metode", "model",
    ),
    "stop_focus_extra": ("jawaban", "bukti", "pertanyaan", "konteks", "sebelumnya"),
    "generic_support": (
        "penulis", "penelitian", "skripsi", "dokumen", "sistem", "metode", "model",
        "bab", "gambar", "tabel", "lampiran", "halaman",
    ),
    "stop_query_terms": (
        "apa", "yang", "dan", "atau", "dengan", "dalam", "pada", "untuk",
        "dari", "ke", "ini", "itu", "adalah", "menurut", "jelaskan",
        "sebutkan", "minimal", "jika", "ada", "metode", "evaluasi",
        "sistem", "dokumen",
    ),
    "stop_text_terms": (
        "yang", "dengan", "dalam", "pada", "untuk", "dari", "atau", "dan",
        "adalah", "ini", "itu", "sebagai", "dapat", "akan", "oleh",
        "menggunakan", "metode", "sistem", "penelitian", "hasil",
        "bab", "tabel", "gambar",
    ),
    "stop_alias": (
        "berapa", "jumlah", "halaman", "dokumen", "file", "pdf", "skripsi", "yang",
        "membahas", "tentang", "pada", "di", "ke", "dari", "dan", "atau",
    ),
}

TEMPLATES = {
    "explain_queries": (
        "metode {label} digunakan karena",
        "alasan menggunakan {label}",
        "karakteristik metode {label}",
        "{label} dalam penelitian ini",
        "tahapan metode {label}",
    ),
    "steps_queries": (
        "tahapan metode {label} terdiri dari",
        "langkah-langkah metode {label} yaitu",
        "prosedur {label} dalam penelitian ini",
        "alur pengembangan dengan metode {label}",
        "tahapan implementasi {label}",
        "penjabaran tahapan {label}",
    ),
    "biased_query": "{query} metode {topic}",
    "steps_query": "tahapan {topic}. {query}",
    "steps_standalone": "Apa saja tahapan dari metode {labels}?",
    "steps_summary_standalone": "Apa saja tahapan utama dari metode {labels}?",
    "context_rewrite": "{query}\n\n(Konteks sebelumnya: {focus})",
    "not_found_answer": "Jawaban: Tidak ditemukan pada dokumen.\nBukti: -",
    "not_found_line": "Tidak ditemukan pada dokumen.",
    "extractive_head": "Jawaban: Informasi relevan ditemukan pada potongan dokumen berikut.\nBukti:\n",
    "retrieval_only_head": (
        "Jawaban: (Mode retrieval-only) Berikut bukti paling relevan dari dokumen untuk pertanyaan ini.\nBukti:\n"
    ),
    "topic_answer_one": "Jawaban: Metode pengembangan yang digunakan adalah {names}.",
    "topic_answer_many": "Jawaban: Metode pengembangan yang teridentifikasi pada konteks adalah {names}.",
    "steps_listed": "Tahapan yang disebutkan: ",
    "steps_note": (
        "Konteks final mengonfirmasi metode ini, tetapi daftar tahapan eksplisitnya tidak tampil "
        "pada potongan yang tersedia."
    ),
    "steps_note_compare": " Perbedaannya dengan metode lain hanya bisa dijelaskan secara parsial.",
    "verification": {
        "partial_caution": "Dukungan konteks ada, tetapi coverage jawaban masih parsial atau asimetris.",
        "partial_ungrounded": "Bukti tersedia, tetapi grounding bagian Jawaban masih parsial.",
        "partial_weak": "Jawaban memiliki dukungan konteks, tetapi belum cukup kuat untuk label verified.",
        "low_format": "Format jawaban atau bagian Bukti belum cukup valid untuk verification yang kuat.",
        "low_no_evidence": "Bagian Bukti tidak memuat bullet yang cukup untuk diverifikasi.",
        "low_uncited": "Jawaban belum menyertakan sitasi CTX yang memadai.",
        "low_out_of_range": "Sebagian sitasi CTX berada di luar rentang konteks yang valid.",
        "low_ungrounded": "Bukti tidak terdukung kuat oleh CTX final yang dirujuk.",
        "low_weak": "Grounding jawaban terhadap CTX final masih lemah.",
        "skipped_config": "Verification dinonaktifkan pada config aktif.",
        "skipped_metadata": "Verification tidak diterapkan pada jalur metadata routing.",
        "not_found": "Jawaban berada pada jalur canonical not_found; verification tidak diberi label positif atau negatif.",
        "verified": "Bukti tersitasi valid dan klaim utama terdukung oleh CTX final.",
    },
    "single_topic_steps": {
        "no_doc": "dokumen target",
        "ambiguous_owner_docs": "Jawaban: Ada lebih dari satu dokumen kandidat yang menggunakan metode {label}, sehingga langkah-langkah lengkapnya belum bisa dipastikan untuk satu skripsi target.\nBukti:\n- Kandidat dokumen owner yang terdeteksi: {docs}",
        "unresolved_owner_doc": "Jawaban: Dokumen skripsi target untuk metode {label} belum bisa dipastikan secara tunggal, sehingga langkah-langkah lengkapnya belum dapat dijabarkan dengan aman.\nBukti: -",
        "steps_found": "Jawaban: Pada dokumen {doc}, langkah-langkah {label} yang tampil eksplisit adalah:\n{steps}\nBukti:\n{cites}",
        "partial": "Jawaban: Pada dokumen {doc}, metode {label} memang terkonfirmasi digunakan, tetapi langkah-langkah lengkapnya tidak tampil secara eksplisit pada potongan konteks yang tersedia.\nBukti:\n{cites}",
    },
    "title_placeholder": "Judul Tidak Terdeteksi",
    "author_placeholder": "Penulis Tidak Terdeteksi",
    "preface_prefix": "puji syukur",
}

NUMERALS = {
    "I": "BAB_I", "1": "BAB_I",
    "II": "BAB_II", "2": "BAB_II",
    "III": "BAB_III", "3": "BAB_III",
    "IV": "BAB_IV", "4": "BAB_IV",
    "V": "BAB_V", "5": "BAB_V",
}

LABEL_STREAMS = {
    "BAB_I": "narasi",
    "BAB_II": "narasi",
    "BAB_III": "narasi",
    "BAB_IV": "narasi",
    "BAB_V": "narasi",
    "DAFTAR_PUSTAKA": "sitasi",
    "UNKNOWN": "narasi",
}

OWNER_LABELS = ("BAB_I", "BAB_III", "BAB_IV", "BAB_V")
LITERATURE_LABELS = ("BAB_II", "DAFTAR_PUSTAKA")
PROCESS_LABELS = ("BAB_III", "BAB_IV", "BAB_V")

# ---------------------------------------------------------------------------

INDONESIAN = RuleSet(
    topics=TOPICS,
    free_text_topics=FREE_TEXT_TOPICS,
    file_rules=FILE_RULES,
    patterns=PATTERNS,
    pattern_lists=PATTERN_LISTS,
    word_lists=WORD_LISTS,
    templates=TEMPLATES,
    numerals=NUMERALS,
    label_streams=LABEL_STREAMS,
    owner_labels=OWNER_LABELS,
    literature_labels=LITERATURE_LABELS,
    process_labels=PROCESS_LABELS,
)
