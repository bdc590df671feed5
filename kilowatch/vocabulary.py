"""Names and numbers of the metering domain."""

from decimal import Decimal

# Location path of one reading, in order; the last part is the meter class.
PATH_PARTS = ("company_name", "building_name", "floor_name", "S0", "L0", "owner_name", "value_name", "meter_class")
METER_PARTS = ("company_name", "building_name", "floor_name", "S0", "L0")
ENERGY_METER = "EM"

# Measures.
REGISTER = "energy_consumption"
PHASE_VOLTAGES = ("volt1", "volt2", "volt3")
PHASE_CURRENTS = ("current1", "current2", "current3")
POWER_FACTOR = "powerfactor"
FREQUENCY = "frequency"
MEASURES = (*PHASE_VOLTAGES, *PHASE_CURRENTS, POWER_FACTOR, FREQUENCY, REGISTER)

# Keys of the wide message and the columns they become.
WIDE_KEYS = {"voltage": "voltage", "current": "current", "pf": "power_factor"}

# Price and emission per unit of energy.
UNIT_COST = Decimal("8.25")
GHG_PER_UNIT = Decimal("0.00058")

# Owners in display order; all others follow.
OWNER_ORDER = ("11", "12", "16", "17", "18", "13", "10", "7", "8", "9")

# Zone of labels and calendar periods, text form of a reading's time, topic, retention, sampling period.
DISPLAY_TZ = "Asia/Kolkata"
SOURCE_TZ = "UTC"
# Seconds ahead of UTC of zones whose law has one offset since 1970 and plans no other.
CONSTANT_ZONES = {"Asia/Kolkata": 19800, "UTC": 0}
TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"
RAW_TOPIC = "iot_raw_data"
RETENTION_HOURS = 168
SAMPLE_SECONDS = 60
MINUTE_SUFFIX = ":00"
