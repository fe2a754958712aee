"""Built-in demonstration tables."""

from __future__ import annotations

import csv
import io
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import xlsx
from .scratch import write_bytes

# Pairs with the category a reader would expect.
ADDRESSES = [
    ("12, MG Road, Chennai", "12 MG Rd Chennai", "Strong Match"),
    ("45 Anna Nagar West", "45 Anna Nagar W", "Strong Match"),
    ("100 Main Street", "200 Main Street", "Possible Match"),
    ("Chennai, Tamil Nadu", "Mumbai, Maharashtra", "No Match"),
    ("12, MG Road, Anna Nagar, Chennai, Tamil Nadu 600040", "12 MG Rd Anna Nagar Chennai TN 600040", "Strong Match"),
    ("Flat 302, Green Valley Apts, Sector 14, Gurgaon", "Unit 302, Green Valley Apartments, Sec 14, Gurugram", "Strong Match"),
    ("742 Evergreen Terrace, Springfield, OR 97477", "742 Evergreen Terr, Springfield, Oregon 97477", "Strong Match"),
    ("No. 25, 1st Floor, 5th Cross, Indiranagar, Bangalore", "#25, Floor 1, 5th Cross Rd, Indira Nagar, Bengaluru", "Strong Match"),
    ("1600 Amphitheatre Pkwy, Mountain View, CA 94043", "1600 Amphitheatre Parkway, Mountain View, California", "Strong Match"),
    ("Suite 500, 350 5th Ave, New York, NY 10118", "Ste 500, 350 Fifth Avenue, NY, New York", "Strong Match"),
]
COMPANIES = [
    ("ABC Pvt. Ltd.", "abc private limited", "Strong Match"),
    ("ABC PVT LTD", "ABC Private Limited", "Strong Match"),
    ("A.B.C. PVT. LTD.", "ABC PRIVATE LTD", "Strong Match"),
    ("Acme Solutions Inc.", "Acme Solutions Incorporated", "Strong Match"),
    ("Reliance Industries Limited", "Reliance Ind Ltd", "Strong Match"),
    ("Global Tech Services Corp", "Global Tech Services Corporation", "Strong Match"),
    ("Tata Consultancy Services Ltd", "Tata Consultancy Services", "Strong Match"),
    ("Microsoft Corporation", "Microsoft Corp", "Strong Match"),
    ("XYZ Pharmaceuticals Ltd", "ABC Logistics Pvt Ltd", "No Match"),
    ("Apex Digital Media LLC", "Apex Digital Solutions LLP", "Likely Match"),
]
NAMES = [
    ("John Michael Smith", "Smith, John M.", "Strong Match"),
    ("John Smith", "Smith John", "Strong Match"),
    ("John A Smith", "John Albert Smith", "Strong Match"),
    ("Dr. Robert Downey Jr.", "Downey, Robert", "Likely Match"),
    ("Priya Ramesh Sharma", "Sharma, Priya R.", "Strong Match"),
    ("Alexander Hamilton", "Hamilton, Alex", "Likely Match"),
    ("Alice Wonder", "Bob Builder", "No Match"),
    ("David K. Johnson", "D. K. Johnson", "Strong Match"),
    ("Sundar Pichai", "Pichai Sundararajan", "Likely Match"),
    ("Karthik Subramanian", "Karthik S", "Likely Match"),
]
CUSTOMERS = [
    ("CUST-1001", "John M. Smith", "Apex Technologies Pvt Ltd", "12, MG Road, Chennai", "+91 98765 43210", "john.smith@gmail.com",
     "CUST1001", "Smith, John Michael", "Apex Tech Private Limited", "12 MG Rd, Chennai, TN", "09876543210", "john.smith@gmail.com"),
    ("CUST-1002", "Priya Sharma", "Global Logistics Inc", "45 Anna Nagar West, Chennai", "+91 98111 22334", "priya.sharma@outlook.com",
     "CUST-1002", "Sharma, Priya", "Global Logistics Incorporated", "45 Anna Nagar W, Chennai", "9811122334", "priya.sharma@outlook.com"),
    ("CUST-1003", "Robert E. Lee", "Acme Corp", "100 Main Street, Springfield", "(555) 019-2834", "rlee@acme.com",
     "CUST-1003", "Robert Lee", "Acme Corporation", "200 Main Street, Springfield", "5550192834", "rlee@acme.com"),
    ("CUST-1004", "Alice Walker", "Starlight Media LLC", "120 Broadway, New York, NY", "+1 212 555 0144", "alice@starlight.com",
     "CUST-9999", "Bob Harris", "Moonlight Enterprises", "742 Ocean Ave, Miami, FL", "+1 305 555 0199", "bob@moonlight.com"),
]
_FIELDS = ["Customer_ID", "Full_Name", "Company", "Address", "Phone", "Email"]
#: name: (columns, rows, default columns to match, suggested type)
SAMPLES = {
    "addresses": (["Address_A", "Address_B", "Expected_Category"], ADDRESSES, ("Address_A", "Address_B"), "address"),
    "companies": (["Company_A", "Company_B", "Expected_Category"], COMPANIES, ("Company_A", "Company_B"), "company"),
    "names": (["Name_A", "Name_B", "Expected_Category"], NAMES, ("Name_A", "Name_B"), "person_name"),
    "customers": ([f"{f}_1" for f in _FIELDS] + [f"{f}_2" for f in _FIELDS], CUSTOMERS, ("Address_1", "Address_2"), "address"),
}


def sample(spark: SparkSession, name: str) -> DataFrame:
    """A built-in table; an unknown name is an error that lists the known ones."""
    if name not in SAMPLES:
        raise KeyError(f"no sample {name!r}; there are {', '.join(SAMPLES)}")
    columns, rows, _, _ = SAMPLES[name]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def write_samples(folder: str, spark: SparkSession | None = None) -> list[str]:
    """The tables as three CSV files and a workbook: in a local folder, or by Spark's file system if a session is given."""
    made: dict[str, bytes] = {}
    for name, file in (("addresses", "sample_addresses.csv"), ("companies", "sample_companies.csv"), ("names", "sample_persons.csv")):
        text = io.StringIO(newline="")
        csv.writer(text).writerows([SAMPLES[name][0], *SAMPLES[name][1]])
        made[file] = text.getvalue().encode()
    made["sample_customers.xlsx"] = xlsx.workbook(*SAMPLES["customers"][:2], sheet="Sheet1")
    for file, content in made.items():
        if spark is None:
            Path(folder).mkdir(parents=True, exist_ok=True)
            (Path(folder) / file).write_bytes(content)
        else:
            write_bytes(spark, f"{folder}/{file}", content)
    return [f"{folder}/{file}" for file in made]
