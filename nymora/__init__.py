"""PySpark-native pseudonymisation engine: detect, mask, restore and audit personal data in text columns."""
