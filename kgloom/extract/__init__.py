"""extract"""
