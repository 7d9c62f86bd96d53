"""Default parameters. Results depend on them."""

MIN_MAPQ = 20
MIN_READ_LENGTH = 30
MAX_MISMATCH_FRACTION = 0.10
MISMATCH_BQ_FLOOR = 10
MAX_SNP_COLUMN_DEPTH = 8_000
MAX_INDEL_COLUMN_DEPTH = 250
MATE_WINDOW = 10_000
MAX_GROUP_SPAN = 10_000
MIN_ALT_OBS = 2
MAX_ALLELES = 6
PLOIDY = 2
MIN_QUAL = 30.0
MAX_GQ = 99.0
MAX_QUAL = 9999.0
EM_ITERATIONS = 50
EM_TOLERANCE = 1e-3
PSEUDOCOUNTS = {"ref": 10.0, "snp": 0.01, "indel": 0.00125, "compound": 0.001}
DIVERSITY = 1e-3
MIN_COPIES_FOR_DIVERSITY = 30
PROBABILITY_FLOOR = 1e-300
MIN_ALT_CONCENTRATION = 1e-12
AB_CONCENTRATION = 150.0
AB_MIN_LOG_LR = -5.0
HOM_ALT_VAF = 0.98
HET_MIN_DEPTH = 4
HET_ERROR_RATE = 0.02
MAX_SITE_ERROR_RATE = 0.4
STRAND_Z = 3.0
GC_WINDOW = 500
GC_BINS = 50
DEPTH_BIN_WIDTH = 0.5
DEPTH_BINS = 2000
MIN_BIN_COUNT = 50
SINGLE_COPY = (0.4, 1.6)
SMOOTH_WINDOW = 5
MAX_OVERFLOW = 0.20
MAX_INBREEDING = 0.99
PARALOG_FDR = 0.01
PARALOG_PRIOR = 0.03
LR_HISTOGRAM = (-100.0, 100.0, 2000)
PARALOG_EM = (0.03, 1e-9, 500)
CARRIER_COPIES = (3, 4, 6, 8)
CARRIER_FREQUENCIES = (0.004, 0.6, 40)
FREQUENCY_POINTS = 200
PARALOG_ERROR = 0.01
MAX_COPY_NUMBER = 4.0
CONTAMINATION = {"min_depth": 10, "min_major": 0.95, "min_minor": 2, "min_minor_fraction": 0.005, "min_batch": 5, "c0": 0.02, "block": 1000, "tolerance": 1e-3, "stable_blocks": 3}
BASE_ERROR = (1e-12, 0.5)
DUST_WINDOW = 64
DUST_THRESHOLD = 20
TANDEM = {"periods": (1, 6), "match": 2, "mismatch": 7, "min_copies": 2}
RUNG_PROMINENCE = 3
BURN_IN_LOCI = 20_000
MAX_READS_PER_LOCUS = 1000
MIN_PURITY = 0.8
BUNDLE_GAP = 50
DEFAULT_BATCH = "all_samples"
STATS = ("num_obs", "q_sum", "fwd", "placed_left", "placed_start", "mapq_sum", "mapq_sum_sq")
SSR_QUAL_CAP = 200.0
CORROBORATION_BALANCE = 0.4
F_SHRINK = 5.0
MAX_SLIP = 10
